"""Alignment, places, containment and lists against plain Python, row after row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import alignment as A
from lodestone.operators import similar as S
from lodestone.operators.containment import containments


def aligned(rows: list[str], entries: list[str]) -> tuple[dict, list[int]]:
    used, out = set(), {}
    for i, text in enumerate(rows):
        if i < len(entries) and entries[i] == text:
            out[i] = (i, "ordered")
            used.add(i)
    for kind, least, fits in (("unordered", 1, lambda a, b: a == b), ("fuzzy", 48, lambda a, b: bool(b) and (a in b or b in a))):
        for i, text in enumerate(rows):
            if i in out or len(text) < least:
                continue
            free = [(abs(j - i), j) for j, e in enumerate(entries) if j not in used and fits(text, e)]
            if free:
                out[i] = (min(free)[1], kind)
                used.add(out[i][0])
    return out, [j for j in range(len(entries)) if j not in used]


LONG = "kunden skal kunne hente ut alle data i et åpent format uten kostnad"
# A key and a ledger with the cases that the scoring tells apart.
CASES = {
    "ordered": ([LONG, "b"], [LONG, "b"]),
    "unordered": (["a", "b", "c"], ["c", "a", "b"]),
    "nearest": (["x", "a", "x"], ["a", "x", "q", "x"]),
    "held": ([LONG], [LONG + " og mer"]),
    "holding": ([LONG], ["q", LONG[5:60]]),
    "short": (["kort krav"], ["kort krav og mer"]),
    "missing": (["a", LONG], ["b"]),
    "twice": (["a"], ["b", "a", "a"]),
    "empty": (["", LONG, ""], ["", ""]),
    "none": (["a"], []),
}


def test_alignment(spark):
    rng = random.Random(2)
    cases = dict(CASES)
    for k in range(25):
        words = [LONG, LONG + " nå", "og " + LONG, LONG[3:], "nå", "a", "b", ""]
        cases[f"random {k}"] = tuple([rng.choice(words) for _ in range(rng.randrange(14))] for _ in range(2))
    rows = [(c, i, t or None) for c, (own, _) in cases.items() for i, t in enumerate(own)]
    entries = [(c, j, t) for c, (_, own) in cases.items() for j, t in enumerate(own)]
    found, left = A.align(spark.createDataFrame(rows, "c string, row int, text string"), spark.createDataFrame(entries, "c string, entry int, text string"), "c")
    got, rest = {}, {c: [] for c in cases}
    for r in found.collect():
        got.setdefault(r.c, {})[r.row] = None if r.entry is None else (r.entry, r.kind)
    for r in left.collect():
        rest[r.c].append(r.entry)
    for c, (own, other) in cases.items():
        wanted, over = aligned(own, other)
        assert got.get(c, {}) == {i: wanted.get(i) for i in range(len(own))}, c
        assert sorted(rest[c]) == over, c


def test_copies_of_a_text_are_sought_once(spark, monkeypatch):
    from lodestone.operators import containment

    sizes, write = [], containment.materialize

    def noted(df, tag):
        out = write(df, tag)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(containment, "materialize", noted)
    rng = random.Random(3)
    own, other = [[rng.choice(words) for _ in range(120)] for words in ([LONG, LONG + " nå"], [LONG + " og mer", "og " + LONG, LONG[3:], "a"])]
    found, _ = A.align(*(spark.createDataFrame([(1, i, t) for i, t in enumerate(side)], f"c int, {place} int, text string") for place, side in (("row", own), ("entry", other))), "c")
    wanted, _ = aligned(own, other)
    assert {r.row: (r.entry, r.kind) for r in found.where("entry is not null").collect()} == wanted
    assert (sizes[0], sizes[3]) == (4, 2)  # the texts of both sides, not their copies


def test_nearest_in_order():
    rng = random.Random(7)
    for _ in range(300):
        places = sorted(rng.sample(range(30), rng.randrange(20)))
        rows, entries = [p for p in places if p % 2 == rng.randrange(2)], sorted(rng.sample(range(30), rng.randrange(12)))
        free, wanted = set(entries), []
        for row in rows:
            if free:
                wanted.append((row, min(free, key=lambda e: (abs(e - row), e))))
                free.discard(wanted[-1][1])
        assert A.nearest_in_order(rows, entries) == wanted


def test_places(spark):
    long = "en to tre fire fem seks sju åtte ni ti elleve tolv"
    text = f"Krav A her. Krav A her. Krav  B–x\n{long} tretten. Krav A her. slutt"
    values = ["krav a her.", "Krav A her.", "finnes ikke", "krav b-x", f"{long} noe annet", "", None, "Krav A HER.", "Krav A her.", "kort finnes ikke"]
    found = spark.createDataFrame([(text, values)], "t string, v array<string>").select(A.source_offsets(F.col("t"), F.col("v"))).first()[0]
    flat = " ".join(text.replace("–", "-").lower().split())
    last = flat.rindex("krav a her.")
    # The lead's search ends behind the whole value's length, so what follows it at once is passed over.
    assert found[:5] == [0, 12, None, 24, flat.index("en to")] and found[5:7] == [None, None] and found[8:] == [None, None]
    assert found[7] == (last if last >= found[4] + len(f"{long} noe annet") else None)


@pytest.mark.parametrize("run", [3, 12])
def test_containment(spark, run):
    rng = random.Random(run)
    make = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(n)))
    hays = [(d, i, make(60)) for d in (1, 2) for i in range(25)]
    needles = [(d, i, make(9) if i % 2 else (h := rng.choice(hays)[2])[rng.randrange(len(h) + 1) :]) for d in (1, 2) for i in range(60)] + [(1, 99, None)]
    found = containments(spark.createDataFrame(needles, "d int, n int, text string"), spark.createDataFrame(hays, "d int, h int, text string"), ["d"], "n", "h", run=run)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted((d, n, h) for d, n, t in needles for e, h, u in hays if d == e and t and t in u)


def alike(a: str, b: str, least: float) -> bool:
    from lodestone.functions.text import SENSITIVE

    keys = [" ".join("".join(" " if c in "`*#>_[](){},.:;!?'\"“”‘’/\\|-" else c for c in x.lower()).split()) for x in (a, b)]
    if not all(keys) or keys[0] == keys[1]:
        return bool(keys[0]) and keys[0] == keys[1]
    said = [[w for w in k.split() if any(map(str.isdigit, w)) or w in SENSITIVE] for k in keys]
    sets = [{w for w in k.split() if len(w) > 2 or any(map(str.isdigit, w))} for k in keys]
    return said[0] == said[1] and all(sets) and len(sets[0] & sets[1]) / min(map(len, sets)) >= least


def kept(items: list[str]) -> list[int]:
    out: list[int] = []
    for i, x in enumerate(items):
        if x and x.strip() and not any(alike(items[o], x, 0.72) for o in out):
            out.append(i)
    return out


def test_lists_keep_what_is_new(spark):
    chain = ["alfa beta gamma delta", "beta gamma delta epsilon", "gamma delta epsilon zeta", "delta epsilon zeta theta", "epsilon zeta theta iota"]
    lists = {
        "chain": chain,  # each like the next alone: the second and fourth go
        "back": chain[::-1],
        "numbers": ["svar innen 3 dager", "svar innen 4 dager", "Svar innen 3 dager!", "svar skal ikke gis"],
        "marks": ["*", "*", " ", "", None, "a b", "A  b.", "alfa"],
        "copies": ["alfa beta"] * 50 + ["beta, alfa"] * 50,
    }
    rng = random.Random(3)
    words = "skal levere vise støtte rapport varsel drift 30 dager ikke".split()
    for k in range(20):
        lists[f"random {k}"] = [" ".join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(40)]
    rows = [(name, i, t) for name, own in lists.items() for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "list string, i long, t string")
    found: dict[str, list] = {}
    for r in S.unique_items(df, ["list"], "i", "t").collect():
        found.setdefault(r.list, []).append(r.i)
    assert {k: sorted(v) for k, v in found.items()} == {name: wanted for name, own in lists.items() if (wanted := kept(own))}
    assert sorted(found["chain"]) == [0, 2, 4]
    assert {(r.list, r.i) for r in S.unique_items(df, ["list"], "i", "t", most=2).collect()} == {(name, i) for name, own in lists.items() for i in kept(own)[:2]}
    assert S.unique_items(df.limit(0), ["list"], "i", "t").isEmpty()

    refs = spark.createDataFrame([("chain", 0, chain[1]), ("numbers", 0, "innen 3 dager svar"), ("copies", 0, None)], "list string, i long, t string")
    left = {(r.list, r.i) for r in S.without_references(df, refs, ["list"], "i", "t").collect()}
    assert left == {(n, i) for n, i, t in rows if not any(n == m and t and r and alike(t, r, 0.76) for m, _, r in [("chain", 0, chain[1]), ("numbers", 0, "innen 3 dager svar")])}


def test_first_repeats(spark):
    from lodestone.operators.similar import identity

    rng = random.Random(5)
    head = " ".join(f"ord{i % 17}x" for i in range(70))
    base = "leveransen skal vise rapporter for alle brukere i kommunen hver uke"
    texts = [None, "", "***", "***", base, base.upper() + "!", base.replace(" ", ""), f"ID-7a {base}", f"{base} ID-7a", f"id-7b {base}", head + " alfa beta", head + " gamma delta", head + " gamma delta nye ord", head + " 9", head[:300]]
    # A block whose first text differs from the rest: they must still find each other.
    texts += [head + "".join(f" helt{i}nytt" for i in range(90)), head + "".join(f" helt{i}nytt" for i in range(60, 150)), head + "".join(f" helt{i}nytt" for i in range(61, 150))]
    texts += [" ".join(rng.choice(("a7", "b8", "skal", "vise", "alle", "ikke")) for _ in range(6)) for _ in range(120)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    key = lambda x: " ".join("".join(" " if c in "`*#>_[](){},.:;!?'\"“”‘’/\\|-" else c for c in (x or "").lower()).split())
    names = lambda k: [w for w in k.split() if any(map(str.isdigit, w)) and any(map(str.isalpha, w))]
    wanted = set()
    for i, x in rows:
        a, near = key(x), []
        for j, y in rows[:i]:
            b = key(y)
            forms = a.replace(" ", "") == b.replace(" ", "") or a[:320] == b[:320] or (names(a) and names(a) == names(b))
            if a and b and (a == b or (forms and alike(x, y, 0.72))):
                near.append((j, a == b))
        if near:
            wanted.add((i, min(near)[0], any(e for _, e in near)))
    assert {tuple(r) for r in S.first_repeats(df, "id", "t").collect()} == wanted and len(wanted) > 20
    assert spark.createDataFrame([("id 7a og 9 x2",)], "k string").select(identity(F.col("k"))).first()[0] == "7a x2"
