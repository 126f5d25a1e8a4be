"""Line, exact, near and substring dedup against brute force on small fixtures."""

import hashlib
import random
from collections import defaultdict

import pytest

from scanloom.llm import exact_dedup as exact_module
from scanloom.llm import near_dedup as near_module
from scanloom.llm.exact_dedup import exact_dedup, exact_groups
from scanloom.llm.line_dedup import line_dedup
from scanloom.llm.near_dedup import components, near_dedup, near_groups
from scanloom.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, DROPS string, keep_id int"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of graded likeness, shared passages, nulls, empties and one long text."""
    rng = random.Random(5)
    base, rows = words(120, 1), []
    for i in range(60):  # a group of near copies: each changes up to twelve words
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9999)}"
        rows.append(" ".join(text))
    passage = words(30, 2)
    rows += [" ".join(words(20, 100 + i) + passage + words(15, 200 + i)) for i in range(20)]
    line = "The Same License Line That Every Document Carries, 2020"
    rows += [f"{' '.join(words(9, 300 + i))}\n  {line if i % 2 else line.upper()}\t\nend {i}\n{line}" for i in range(12)]
    rows += [None, "", " \n\t", "one two", "One  TWO", "a b c d e", "A b\tc d e", "a b c d e f", None, "   one two"]
    rows.append(" ".join(words(20000, 9)))
    rows.append("ha " * 3000)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(k, rows[k2]) for k, k2 in enumerate(order)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_words(text):
    return (text or "").encode().split()


def test_line_dedup_matches_brute_force(spark, corpus):
    found = {r["doc_id"]: r for r in line_dedup(frame(spark, corpus)).collect()}
    holders = defaultdict(set)
    for i, t in corpus:
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACES))
            if len(key) >= 40:
                holders[key].add(i)
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders[lower(x.strip(SPACES))]) < 5 or max(h) == i]
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_line_dedup_repeated_and_null_ids(spark):
    line = "x" * 45
    rows = [(i, line) for i in range(5)] + [(4, line + "\nother"), (None, line)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_dropped"]) for r in line_dedup(frame(spark, rows)).collect())
    assert got == [(-1, 0), (0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]
    assert line_dedup(frame(spark, []), min_docs=1).count() == 0


def squeezed(text):
    return "".join(c for c in text or "" if c not in SPACES)


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_groups_match_brute_force(spark, corpus, bits, monkeypatch):
    monkeypatch.setattr(exact_module, "MAX_CHUNK", 64)
    monkeypatch.setattr(exact_module, "MIN_CHUNK", 16)
    rows = [x for x in corpus if len(x[1] or "") < 2000] if bits < 128 else corpus  # every hash clashes
    found = {r["doc_id"]: r for r in exact_groups(frame(spark, rows), bits=bits).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i))
    for i, t in rows:
        group = groups[squeezed(t)]
        keep = min(group)[1]
        assert found[i].asDict() == {"doc_id": i, "keep_id": keep, "group_size": len(group), "kept": keep == i, "text_sha256": hashlib.sha256(squeezed(t).encode()).hexdigest()}


def test_exact_dedup_keeps_rows_whole(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (None, "c"), (4, None), (5, "")]
    kept = exact_dedup(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "DROPS", "keep_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    # other texts under a dropped or null id stay; of identical rows one does
    rows += [(1, "other"), (None, "lonely"), (7, "same"), (7, "same"), (7, "sa me"), (7, "s ame"), (None, "twin"), (None, "twin")]
    got = sorted((r["doc_id"] or 0, squeezed(r["text"])) for r in exact_dedup(frame(spark, rows)).collect())
    assert got == [(0, "lonely"), (0, "twin"), (1, "other"), (2, "ab"), (3, "c"), (4, ""), (7, "same")]
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_components(rows, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = split_words(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        root[i] = i

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and (p := top(i)) != (q := top(j)):
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.fixture(scope="module")
def templates(corpus):
    """Documents of one template, too different to be linked but for pairs and short chains among them."""
    rng, rows = random.Random(12), list(corpus)
    base = words(100, 40)
    for i in range(150):
        text, own = list(base), i if i % 3 else i - i % 9
        at = own % 80
        text[at : at + 20] = words(20 + own % 3, 1000 + own)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(len(text))] = f"y{rng.randrange(9999)}"
        rows.append((1000 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("percent", "block", "crowd"), [(85, 256, 1024), (80, 7, 1 << 20), (80, 16, 4), (85, 16, 4), (60, 16, 4)])
def test_near_groups_match_brute_force(spark, templates, percent, block, crowd, monkeypatch):
    monkeypatch.setattr(near_module, "BLOCK", block)  # small blocks: many tasks for one bucket
    monkeypatch.setattr(near_module, "CROWD", crowd)  # small crowds: the prefix filter decides who is compared
    corpus = templates
    want = brute_components(corpus, percent)
    found = near_groups(frame(spark, corpus), percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_prefix_clusters_lose_no_link(spark, templates):
    """Every pair of at least the wanted similarity and of two labels lies in one cluster; of the near misses most are in none."""
    rows = [(i, t) for i, t in templates if i >= 1000]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [split_words(lower(t))]}
    crowd = spark.createDataFrame([(i, i) for i, _ in rows], "id long, label long")
    for percent in (60, 80, 85):
        found = {r["node"]: r["label"] for r in near_module.prefix_clusters(crowd, spark.createDataFrame(rows, "id long, text string"), 5, percent).collect()}
        links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        assert links and all(found.get(i, -i) == found.get(j, -j) for i, j in links)
        assert percent < 80 or len(found) < len(rows)


def test_near_dedup_odd_rows(spark):
    text = " ".join(words(50, 3))
    rows = [(3, text), (7, text.upper().replace("É", "é")), (7, "something else entirely"), (9, "Something else entirely"), (None, text), (1, None), (2, "")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(frame(spark, rows)).collect()}
    assert got == {(3, 3, True), (7, 3, False), (9, 3, False), (None, None, True), (1, 1, True), (2, 2, True)}
    kept = near_dedup(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "DROPS", "keep_id"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3]
    assert near_groups(frame(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(100, 200), (200, 201), (300, 300)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert all(found[i] == 0 for i in range(41))
    assert all(found[i] == 100 for i in [*range(100, 130), 200, 201])


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    """Either way gives every node the smallest one of its component; few edges take a few jobs, not rounds of them."""
    monkeypatch.setattr(near_module, "FEW_EDGES", few)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    label = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in label:
        for x, y in edges:
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
    made = []
    real = near_module.staged
    monkeypatch.setattr(near_module, "staged", lambda df, **how: made.append(1) or real(df, **how))
    found = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r["node"]: r["label"] for r in found} == label and len(found) == len(label)
    assert len(made) == 2 if few else len(made) > 3
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize(("large", "bucket", "per_share", "cell"), [(1 << 20, 1 << 18, 4, 6 << 20), (50, 40, 4, 4000), (20, 2, 1, 2000)])
def test_substring_dedup_matches_brute_force(spark, corpus, large, bucket, per_share, cell):
    # small limits: large buckets are dealt to parts, parts to shares that meet again
    rows = [*corpus, (10_000, "tab\tand  double " + " ".join(words(30, 2)))]
    found = {r["doc_id"]: r for r in substring_dedup(frame(spark, rows), bucket=bucket, large=large, per_share=per_share, cell=cell).collect()}
    first = {}
    for i, t in sorted(rows):
        w = split_words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = split_words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["text"]) == (len(w), len(gone), kept)


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(words(20, 4))
    rows = [(5, text), (5, text + " tail"), (6, "head " + text), (None, text), (2, None)]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == [(-1, 20, 0), (2, 0, 0), (5, 20, 0), (5, 21, 0), (6, 21, 20)]
    assert substring_dedup(frame(spark, [])).count() == 0


def test_staged_tables_can_be_released(spark):
    from scanloom.llm.common import release, staged

    table = staged(spark.range(10))
    assert table.count() == 10
    release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|not exist"):
        spark.catalog.clearCache()
        staged_again = spark.read.parquet(table.inputFiles()[0])
        staged_again.count()
