"""Problems 1 and 4 against all pairs."""

import itertools
import random
import unicodedata

import pytest

from veilspark.llm import classes, forms, neardup, overlap

COLUMNS = "id string, text string, cls bigint, a string, plain string"


def all_likenesses(texts):
    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
        return " ".join(t.lower().split())

    sets = {i: {p[k : k + 5] for k in range(len(p) - 4)} for i, t in texts if t is not None and len(p := plain(t)) >= 40}
    return sets


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["Straße", "café", "窓口は", "shipment", "ledger", "blue", "folder", "ref", "Ｏｒｄｅｒ", "naïve", "42", "resumé"]
    base = [" ".join(rng.choices(words, k=30)) + f" unique {rng.random()}" for _ in range(25)]
    edited = []
    for t in base:
        cut = rng.randrange(10, len(t) - 10)
        edited.append(t[:cut] + rng.choice(["", "​", " extra words ", "X"]) + t[cut + rng.randrange(6) :])
    out = [(f"t{k:03d}", t) for k, t in enumerate([*base, *edited, base[0], base[0].upper(), "é" * 60, "é" * 60, "tiny"])]
    return [*out, out[0], ("n1", None), ("n2", ""), ("n3", " "), (None, base[1]), ("long", base[2] + " " + "lorem ipsum dolor " * 4000)]


def test_plain_and_windows():
    assert forms.plain("  Ａ​B  c­D\n") == "ab cd" and forms.plain("") == ""
    w = forms.Windows(["abcdef", "xy", "bcdef"])
    at, n = w.positions(5)
    h = w.hashes(at, 5)
    assert n.tolist() == [2, 0, 1] and h[1] == h[2] != h[0]
    assert classes.likenesses(["abcdefgh"], ["abcdefgh"])[0] == 1 and abs(classes.likenesses(["abcdefgh"], ["abcdefgX"])[0] - 3 / 5) < 1e-9


def test_p4_all_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], COLUMNS)
    sets = all_likenesses([r for r in rows if r[0]])
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if likeness(sets[a], sets[b]) >= 0.6}
    assert {tuple(r) for r in neardup.found(df).collect()} == want and want
    groups = {r.id: r for r in neardup.groups(df).collect()}
    assert set(groups) == set(sets)
    assert all(groups[a].group_id == groups[b].group_id for a, b in want)
    parts: dict = {}
    for i, r in groups.items():
        parts.setdefault(r.group_id, set()).add(i)
    for part in parts.values():  # every group hangs together by the links
        seen, todo = set(), [next(iter(part))]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [b if a == x else a for a, b in want if x in (a, b) and {a, b} - seen - {x}]
        assert seen >= part


def _versions(n, edits=9):
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=390))

    def version():
        text = list(base)
        for at in rng.sample(range(390), edits):
            text[at] = rng.choice("0123456789")
        return "".join(text)

    return [version() for _ in range(n)]


def test_p4_long_runs_give_all_pairs(spark):
    df = spark.createDataFrame([(t,) for t in _versions(150)], "text string")
    common, parts = neardup.common_keys(df)
    assert not len(common)
    keys = neardup.keyed(df, common, parts).cache()
    whole, cut = ({tuple(r) for r in neardup.candidates(keys, parts, longest=n).collect()} for n in (1000, 16))
    assert whole == cut and len(whole) > 5_000 and all(a < b for a, b in whole)


def test_p4_common_left_keys_are_split_without_loss(spark):
    df = spark.createDataFrame([(t,) for t in _versions(150)], "text string")
    common, parts = neardup.common_keys(df, least=2)
    assert len(common)
    split, whole = ({tuple(r) for r in neardup.candidates(neardup.keyed(df, c, parts), parts, longest=40).collect()} for c in (common, common[:0]))
    assert split == whole and len(whole) > 5_000


def test_p4_pairs_at_the_threshold_are_candidates():
    rng, letters = random.Random(6), "abcdefghijklmnopqrstuvwxyz "
    left = ["".join(rng.choices(letters, k=390)) for _ in range(1000)]
    right = ["".join("#" if k in range(10, 390, 20) else c for k, c in enumerate(t)) for t in left]
    assert all(0.6 <= s < 0.61 for s in classes.likenesses(left, right))
    lefts, rights = neardup.half_keys(left + right)
    a = list(range(1000))
    b = [1000 + k for k in a]
    enough = neardup.agreeing(rights, a, b) >= neardup.AGREE
    assert enough.all()
    assert ((lefts[a] == lefts[b]).any(1) & (rights[a] == rights[b]).any(1)).mean() > 0.97


def test_p4_recall_between_060_and_065(spark):
    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz "
    rows, want = [], 0
    for k in range(400):
        text = "".join(rng.choices(letters, k=rng.choice([60, 200, 500])))
        twin = list(text)
        for at in rng.sample(range(len(text)), len(text) // 20):
            twin[at] = rng.choice("0123456789")
        if 0.6 <= classes.likenesses([text], ["".join(twin)])[0] < 0.65:
            rows += [(f"a{k:03d}", text), (f"b{k:03d}", "".join(twin))]
            want += 1
    got = neardup.found(spark.createDataFrame(rows, "id string, text string")).count()
    assert want > 150 and got >= 0.95 * want


def test_p4_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 10)
    rows = [(f"k{k:03d}", "the same text of more than forty characters, over and over") for k in range(75)]
    assert neardup.found(spark.createDataFrame(rows, "id string, text string")).count() == 75 * 74 // 2


def test_p1_all_pairs(spark, rows):
    left, right = [r for k, r in enumerate(rows) if k % 2], [r for k, r in enumerate(rows) if k % 2 == 0] + [rows[1]]
    a, b = (spark.createDataFrame([(i, t, 1, "x", "y") for i, t in part], COLUMNS) for part in (left, right))
    sa, sb = all_likenesses([r for r in left if r[0]]), all_likenesses([r for r in right if r[0]])
    want = {(i, j) for i, j in itertools.product(sa, sb) if likeness(sa[i], sb[j]) >= 0.6}
    assert {tuple(r) for r in overlap.found(a, b).collect()} == want and want


def test_p1_short_texts_with_one_edit(spark):
    rng = random.Random(8)
    left = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=45)) for _ in range(400)]
    right = [t[:at] + "#" + t[at + 1 :] for t in left for at in [rng.randrange(45)]]
    a, b = (spark.createDataFrame([(f"k{k:03d}", t) for k, t in enumerate(part)], "id string, text string") for part in (left, right))
    assert {tuple(r) for r in overlap.found(a, b).collect()} == {(f"k{k:03d}", f"k{k:03d}") for k in range(400)}


def _pairs_of(spark, left, right):
    a, b = (spark.createDataFrame([(f"k{k:03d}", t) for k, t in enumerate(part)], "id string, text string") for part in (left, right))
    sa, sb = ({i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in enumerate(part)} for part in (left, right))
    want = {(f"k{i:03d}", f"k{j:03d}") for i in sa for j in sb if likeness(sa[i], sb[j]) >= 0.6}
    return want, {tuple(r) for r in overlap.found(a, b).collect()}


def test_p1_common_frames(spark):
    frame = "the records unit approved the renewal form for the third time this year without waiting for "
    rows = [(f"k{k:03d}", frame + " ".join(random.Random(k).choices(["amber", "birch", "cedar", "dune", "elm", "fern", "gorse", "heath"], k=40))) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {tuple(r) for r in overlap.found(df.where("id < 'k030'"), df).collect()} >= {(f"k{k:03d}", f"k{k:03d}") for k in range(30)}


def test_p1_versions_of_one_template_all_pair(spark, monkeypatch):
    texts = _versions(200, edits=8)
    want, got = _pairs_of(spark, texts[:20], texts[20:])
    assert got == want and len(want) == 20 * 180
    monkeypatch.setattr(overlap, "BLOCK", 16)  # common runs in blocks, common suffixes over several parts
    monkeypatch.setattr(overlap, "PART", 50)
    want, got = _pairs_of(spark, texts[:20], texts[20:])
    assert got == want


def test_p1_common_run_costs_little_a_pair(spark):
    """A run of 9,000 by 9,000 records, as large tables have many: near pairs come out, and the others take a few nanoseconds each."""
    import time

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(2), 9000
    sketch = rng.integers(0, 256, (2, n, overlap.BINS // 8), dtype=np.uint8)
    sketch[1, :50] = sketch[0, :50]
    number, grams = np.full((n, 2), 30, np.uint32), np.full(n, 120, np.uint8)
    rows = []
    for s in (0, 1):
        rec = (np.arange(n, dtype=np.uint64) + np.uint64(s * n)) << np.uint64(1)
        rows += overlap._split(np.zeros(n, np.int64), 3, s, [np.full(n, 7, overlap.KEPT[0][0]), rec, number, grams, sketch[s]])
    df = spark.createDataFrame(pa.Table.from_batches([overlap._batch(rows)]).to_pandas(), overlap.ROWS)
    pairs = lambda rows: {tuple(r) for r in overlap.paired(rows, overlap.Bounds([], [], 1, 1), 0.6).collect()}
    assert not pairs(df.where("side = 0"))  # workers are up
    began = time.time()
    got = pairs(df)
    assert {(k, k + n) for k in range(50)} <= got and len(got) < 2000 and time.time() - began < 8


@pytest.mark.parametrize("length", [60, 190, 500])
def test_p1_sketches_tell_unlike_texts_from_near_ones(length):
    """Pairs with an edit in every 25 characters stay, unlike ones of one frame go: 0.3 of their characters are equal."""
    import numpy as np

    rng = random.Random(length)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    frame, short = draw(length * 3 // 10), length < 200
    a = [frame + draw(length - len(frame)) for _ in range(400)]
    b = []
    for x in a:
        text = list(x)
        for at in range(12, length, 25):
            text[at] = "0"
        b.append("".join(text))
    (n, x), (n2, y) = (overlap._sketches(t, short) for t in (a, b))
    assert [len({t[i : i + 5] for i in range(length - 4)}) for t in a] == n.tolist()
    bits = np.bitwise_count(x[:, None] ^ y).sum(2, dtype=int) <= overlap._apart(0.6)[int(short), overlap._steps(n)[:, None], overlap._steps(n2)]
    assert np.diag(bits).sum() >= 399 and bits.sum() - np.diag(bits).sum() < 1600  # 0.01


def test_p1_sizes_too_far_apart_never_meet():
    import numpy as np

    rng = np.random.default_rng(3)
    unit, grams = (np.sort(rng.integers(0, 3, 700)).astype(np.uint64) for _ in range(2)), (rng.integers(20, 500, 700) for _ in range(2))
    sides = []
    for u, g in zip(unit, grams, strict=True):
        order = np.lexsort((g, u))
        sides.append((u[order], g[order], [np.zeros(700, np.uint32)] * 3))
    (u, g, w), (u2, g2, w2) = sides
    want = {(x, y) for x in range(700) for y in range(700) if u[x] == u2[y] and min(g[x], g2[y]) >= 0.6 * max(g[x], g2[y])}
    met = [(x, y) for xs, ys in overlap._met(np.zeros(700, np.int64), u, overlap._steps(g), w, u2, overlap._steps(g2), w2, 0.6) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)]
    assert len(met) == len(set(met)) and want <= set(met)
    assert all(u[x] == u2[y] and min(g[x], g2[y]) >= 0.52 * max(g[x], g2[y]) for x, y in met)


def test_p1_random_edits_near_the_threshold(spark):
    rng = random.Random(9)
    left = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([100, 250, 400, 800]))) for _ in range(300)]
    right = ["".join(rng.choice("0123456789") if rng.random() < 0.045 else c for c in t) for t in left]
    want, got = _pairs_of(spark, left, right)
    assert got <= want and len(want) > 150 and len(got) >= 0.95 * len(want)


def test_p1_coverage_counts_shared_characters():
    assert overlap.covered("x" * 50, "y" * 50) == (0, 0)
    a, b = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEF", "zyxwvutsrqponmlkjihgfedcba"
    assert overlap.covered(a + b, "#" * 30 + a) == (42, 42)


def test_p1_report(spark, rows):
    held = spark.createDataFrame([(i, t, "dev", "s") for i, t in rows[:5]], "id string, text string, split string, source string")
    r = overlap.report(held, spark.createDataFrame(rows, "id string, text string")).first()
    assert r.of_records == 5 and r.records == 5 and r.pairs >= 5


def test_empty(spark):
    none = spark.createDataFrame([], "id string, text string")
    assert neardup.found(none).count() == 0 and overlap.found(none, none).count() == 0 and neardup.groups(none).count() == 0
