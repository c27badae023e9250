"""Plain Python versions of the operators, from their definitions alone."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def print64(text: str | None, shingle: int = 3) -> int:
    words = SPACED.findall(lower(text or ""))
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    root = {p: p for _, p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for doc, p in prints:
        least[find(p)] = min(doc, least.get(find(p), doc))
    return {p: least[find(p)] for p in distinct}


def simhash(docs: list[tuple[int, str | None]]) -> set[tuple]:
    prints = [(doc, print64(text)) for doc, text in docs]
    least = components(prints)
    return {(doc, f"{p:016x}", least[p]) for doc, p in prints}


def measures(text: str | None) -> tuple:
    text = text or ""
    words = SPACED.findall(text)
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    bad = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), bad


def token_files(docs: list[tuple[int, str | None]]) -> set[tuple]:
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, set()
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        out.add((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def pieces(docs: list[tuple[int, str | None]]) -> set[tuple]:
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = set()
    for doc, text in docs:
        ids = own.encode(text or "")
        out.add((doc, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids))))
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 10) -> set[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        words = FOLDED.findall(lower(text or ""))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = set()
    for doc, text in docs:
        words = FOLDED.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if got := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.add((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def warc(pages: list[tuple[int, str | None]]) -> set[tuple]:
    first: dict[bytes, int] = {}
    for page, html in pages:
        body = (html or "").encode()
        first[body] = min(page, first.get(body, page))
    out = set()
    for page, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = first[body] != page
        out.add((page, len(body), digest, "revisit" if revisit else "response", first[body] if revisit else None))
    return out


def repeats(docs: list[tuple[int, str | None]], size: int = 50) -> set[tuple]:
    split = {doc: SPACED.findall(text or "") for doc, text in docs}
    first: dict[tuple, int] = {}
    for doc in sorted(split):
        for i in range(len(split[doc]) - size + 1):
            first.setdefault(tuple(split[doc][i : i + size]), doc)
    out = set()
    for doc, words in split.items():
        gone = {j for i in range(len(words) - size + 1) if first[tuple(words[i : i + size])] < doc for j in range(i, i + size)}
        out.add((doc, len(words), len(gone), sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    return out


def boilerplate(pages: list[tuple], ratio: float = 0.1, least: int = 2) -> dict:
    """pages: (key, site, text) to {key: text left}."""
    total, held = Counter(), Counter()
    for _, site, text in pages:
        total[site] += 1
        held.update({(site, line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")})
    gone = {x for x, n in held.items() if n >= least and n > ratio * total[x[0]]}
    return {key: None if text is None else "\n".join(x for x in text.split("\n") if (site, x.strip(" \t\n\x0b\x0c\r")) not in gone) for key, site, text in pages}


def vector_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> set[tuple]:
    """rows: (vec_id, vector, label), with distinct ids."""
    kept = sorted((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return set()
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p: int, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(p, c[p])[1]].append(c[p])
            for k, own in held.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (*_, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    return {(i, "".join(f"{k:02x}" for _, k in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)}


def importance(docs: list[tuple[int, str | None]], target: list[str | None]) -> set[tuple]:
    def features(text: str | None) -> tuple[int, list[int]]:
        words = FOLDED.findall(lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own = [(doc, *features(text)) for doc, text in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for text in target for b in features(text)[1])
    ratio = lambda b: (t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))
    scored = []
    for doc, n_words, f in own:
        weight = sum(math.floor(1000 * math.log(ratio(b))) for b in f)
        h = int(sha(f"42:{doc}")[:8], 16)
        scored.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((-score, doc) for doc, _, _, score, n_words in scored if n_words >= 20)
    rank = {doc: i + 1 for i, (_, doc) in enumerate(fit[: 5 * len(fit) // 100])}
    return {(doc, n, weight, score, rank.get(doc)) for doc, n, weight, score, _ in scored}


def url_verdict(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    place = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, path = lower(rest[:place]), re.split("[?#]", rest[place:])[0]
    fit = [(h.count("."), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, default)
