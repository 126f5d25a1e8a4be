"""Classifiers, decontamination, chat formatting, packing, sharding and the pipeline."""

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import chat_format as chat_module
from scanloom.llm import packing as packing_module
from scanloom.llm import quality as quality_module
from scanloom.llm import registry
from scanloom.llm import toxicity as toxicity_module
from scanloom.llm.chat_format import format_chats
from scanloom.llm.common import staged
from scanloom.llm.decontaminate import decontaminate, leaks
from scanloom.llm.packing import boundaries, pack
from scanloom.llm.quality import fit_quality, keep_good, score_quality
from scanloom.llm.sharding import shards
from scanloom.llm.text_kernels import Words, gram_hashes, span_hashes
from scanloom.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_kernels():
    texts = ["a bb  a\tbb".encode(), b"", " é\nbb ".encode()]
    words = Words(texts)
    assert np.diff(words.first).tolist() == [4, 0, 2]
    h = words.hashes
    assert h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    assert len(gram_hashes(h[:4], 5)) == 0 and gram_hashes(h[:4], 2)[0] == gram_hashes(h[:4], 2)[2]
    buf = np.frombuffer(b"abcabcabc" * 50, dtype=np.uint8)
    whole, chunked = (span_hashes(buf, np.arange(400), np.arange(400) + 7, chunk=c) for c in (1 << 20, 16))
    assert (whole == chunked).all() and len(set(whole.tolist())) == 3


# ---- classifiers: held-out accuracy, and what is never an input


@pytest.mark.parametrize(("label", "modulus", "rest", "least"), [("quality", 3, 1, 0.97), ("toxic", 4, 2, 0.88)])
def test_held_out_accuracy(spark, label, modulus, rest, least):
    name = "op8_quality" if label == "quality" else "op1_toxicity"
    rows = registry.queries()[name](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % modulus == rest for i in rows.doc_id]).all()
    held = rows[rows.held_out & rows.doc_id.isin(truth.index)]
    assert (held.predicted.to_numpy() == truth.loc[held.doc_id].to_numpy()).mean() >= least


def odd_documents(spark):
    rows = [(1, None, None, "s"), (2, "", "en", None), (None, "some words here", "xx", "s"), (4, " \n\t", "en", "s"), (4, "word " * 50_000, "en", "s")]
    return spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_models_on_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = odd_documents(spark)
    quality, toxic = fit_quality(docs, labels), fit_toxicity(docs, labels)
    scored = score_quality(odd, quality).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    assert keep_good(odd, quality, least=0.0).columns == odd.columns and keep_good(odd, quality, least=0.0).count() == 5
    again = score_toxicity(odd, toxic).collect()
    assert len(again) == 5 and all(0 <= r["score"] <= 1 for r in again)
    # neither language nor source nor id is an input of a score
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("other"), "doc_id": F.col("doc_id") + 10_000})
    a = {r["doc_id"]: r["score"] for r in score_toxicity(docs, toxic).collect()}
    assert all(a[r["doc_id"] - 10_000] == r["score"] for r in score_toxicity(moved, toxic).collect())
    # nothing to learn from
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()} == {0.0}
    assert score_quality(docs.limit(0), quality).count() == 0 and score_toxicity(docs.limit(0), toxic).count() == 0
    # of one class: the share of ones
    for value in (0, 1):
        alike = labels.where("doc_id < 50").withColumn("toxic", F.lit(value))
        assert {r["score"] for r in score_toxicity(odd, fit_toxicity(docs, alike)).collect()} == {float(value)}
    # one row of each class, and a table of documents in other partitions with repeated ids
    few = labels.where("doc_id in (0, 1)").withColumn("toxic", F.col("doc_id").cast("int"))
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(odd, fit_toxicity(docs, few, modulus=1, held_out=1)).collect())
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    one, two = (fit_quality(d, labels) for d in (twice, twice.repartition(7, "text")))
    assert [r["score"] for r in score_quality(odd, one).collect()] == [r["score"] for r in score_quality(odd, two).collect()]


@pytest.mark.parametrize("shard_bytes", [1 << 14, 1 << 30])
def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch, shard_bytes):
    """A word of a few among very many rows, and one of long texts alone, count; shards don't change what is counted."""
    monkeypatch.setattr(toxicity_module, "SHARD_BYTES", shard_bytes)
    last = spark.range(4_100).orderBy(F.xxhash64("id").desc(), "id").limit(80).toPandas().id.tolist()  # of the ones the last by hash
    rows = [(i, "one rotten day" if i in set(last) else "one vile day" if i < 4_100 else "one kind day", int(i < 4_100)) for i in range(8_200)]
    rows += [(10_000 + i, "a plain word " * 3_000 + ("nasty" if i % 2 else "lovely"), i % 2) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("lang", F.lit("en"))
    docs, labels = table.drop("toxic"), table.select("doc_id", "toxic")
    shards = toxicity_module.learning_shards(docs, labels, 1, 1, "doc_id", "text", "toxic", "lang").collect()
    assert (len(shards) > 1) == (shard_bytes == 1 << 14) and np.sum([r["counts"] for r in shards]) == len(rows)
    words = [toxicity_module._unpacked(bytes(r["words"])) for r in shards]
    assert sorted(np.concatenate(words).tolist()) == sorted(toxicity_module.buckets([t.encode() for _, t, _ in rows])[0].tolist())
    model = fit_toxicity(docs, labels, modulus=1, held_out=1)
    asked = spark.createDataFrame([(1, "one rotten day"), (2, "one vile day"), (3, "one kind day"), (4, "nasty"), (5, "lovely")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    score = {r["doc_id"]: r["score"] for r in score_toxicity(asked, model).collect()}
    assert min(score[1], score[2]) > 0.5 > score[3] and score[4] > score[5]


def test_discriminant_matches_the_textbook():
    """Scores from cached factors equal log densities of two Gaussians, computed from the covariances."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 4)), rng.normal(0.8, 1.7, (60, 4))])
    y = np.array([0] * 80 + [1] * 60)
    model = quality_module.fit(x, y, [80, 60])
    z = (x - model.centre) / model.scale
    logs = []
    for mean, root in zip(model.means, model.roots, strict=True):
        factor = np.linalg.inv(root)
        cov, d = factor @ factor.T, z - mean
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.difference(x), logs[1] - logs[0])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.75


def test_pooling_matches_a_loop_over_windows():
    """Precomputed tables and slices give what sliding each filter over the embeddings gives."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(9, toxicity_module.DIM))
    rows[0] = 0
    filters = [rng.normal(size=(k, toxicity_module.DIM, toxicity_module.FILTERS)) for k in toxicity_module.WIDTHS]
    bias, weights = rng.normal(size=12), rng.normal(size=12)
    known = np.sort(rng.choice(1 << 20, 8, replace=False)).astype(np.int32)
    model = toxicity_module.Convolutional(known, rows, filters, bias, weights, 0.3)
    texts = [rng.choice(np.append(known, 5), n).astype(np.int32) for n in (0, 1, 2, 7, 30)]
    got = model.raw(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), model.tables())
    for t, raw in zip(texts, got, strict=True):
        words = [rows[1 + known.tolist().index(w)] if w in known else rows[0] for w in t.tolist()] + [rows[0]] * 3
        pooled = []
        for f in filters:
            active = [sum(words[i + j] @ f[j] if i + j < len(words) else 0 * bias[:4] for j in range(len(f))) for i in range(len(t) + 1)]
            pooled.append(np.max(active, axis=0))
        assert np.isclose(raw, np.maximum(np.concatenate(pooled) + bias, 0) @ weights + 0.3, atol=1e-4)


# ---- decontamination


def tokens(text):
    import re

    return re.findall(r"\w+", (text or "").lower())


def test_leaks_match_brute_force_on_verbatim_passages(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = {i: grams(tokens(t)) for i, t in items}
    brute = {(d, i) for d, t in docs for own in [grams(tokens(t))] for i, g in wanted.items() if g and len(g & own) >= 0.8 * len(g)}
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op2_template_decontamination"](spark, SF).where("literal >= 0.8").collect()}
    assert brute and got == brute


ITEM = "Yesterday Alice bought 3 kg of apples and 12 pears from Bob while Alice paid 40 dollars to Bob"
OTHER = "Yesterday Carol bought 7 kg of apples and 99 pears from Dave while Carol paid 41 dollars to Dave"


def test_templates_and_slot_consistency(spark):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "tiny item", 0), (None, "x", 0), (3, None, 0)], "item_id long, text string, literal int")
    broken = OTHER.replace("while Carol", "while Dave")  # two people become one
    texts = [(1, "Foo. " + OTHER + ", bar"), (2, ITEM.lower()), (3, broken), (4, None), (5, ""), (None, ITEM), (6, "tiny item"), (7, "unrelated words " * 100), (2, "repeated id"), (8, ITEM), (8, ITEM)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leaks(docs, bench).collect()}
    assert got == {(1, 1, "reparameterised"), (2, 1, "verbatim"), (8, 1, "verbatim")}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 7]
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def template_by_hand(words):
    """(kind, text) of a text's template tokens: runs of numbers, runs of capitalised words, or a word."""
    out = []
    for w in words:
        kind = "number" if w.isdigit() else "name" if w[0].isupper() else ""
        if kind and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + " " + w)
        else:
            out.append((kind, w))
    return out


def consistent_share(item, doc):
    """The best share, over all shifts, of the item's template windows that the document has there under one mapping."""
    mine, theirs = template_by_hand(item), template_by_hand(doc)
    form = lambda x: [k or w for k, w in x]
    a, b = form(mine), form(theirs)
    wanted, best = {tuple(a[p : p + 5]) for p in range(len(a) - 4)}, 0.0
    for shift in range(-len(a), len(b)):
        found = [p for p in range(len(a) - 4) if 0 <= p + shift <= len(b) - 5 and a[p : p + 5] == b[p + shift : p + shift + 5]]
        votes = defaultdict(Counter)
        for p in found:
            for q in range(p, p + 5):
                if mine[q][0]:
                    votes[mine[q]][theirs[q + shift][1]] += 1
        chosen = {k: max(v, key=v.get) for k, v in votes.items()}
        names = Counter(v for k, v in chosen.items() if k[0] == "name")
        fits = lambda q: not mine[q][0] or (theirs[q + shift][1] == chosen[mine[q]] and (mine[q][0] != "name" or names[chosen[mine[q]]] == 1))  # noqa: B023, E731
        best = max(best, len({tuple(a[p : p + 5]) for p in found if all(fits(q) for q in range(p, p + 5))}) / len(wanted))
    return best


def test_every_alignment_is_tried(spark):
    """Consistent and inconsistent copies in any order and number, against a search over all shifts."""
    rng = random.Random(11)
    names = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"]
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    items = []
    for k in range(6):
        form = ["at"] + [rng.choice(["A", "B", "N", "M"] if i % 3 == 2 else plain) for i in range(26)]
        items.append((k, form))

    def copy(form, honest):
        who, many = rng.sample(names, 2), rng.sample(range(10, 99), 2)
        said = []
        for w in form:
            if not honest:
                who, many = rng.sample(names, 2), rng.sample(range(10, 99), 2)
            said.append({"A": who[0], "B": who[1], "N": str(many[0]), "M": str(many[1])}.get(w, w))
        return said

    bench = [(k, copy(form, True)) for k, form in items]
    docs = []
    for d in range(60):
        words = [rng.choice(plain) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            words += copy(rng.choice(items)[1], rng.random() < 0.4) + [rng.choice(plain) for _ in range(rng.randrange(0, 40))]
        docs.append((d, ["the", *words]))
    want = {(d, k): consistent_share(i, w) for d, w in docs for k, i in bench}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["template"] for r in leaks(frame(docs, "doc_id"), frame(bench, "item_id")).where("kind = 'reparameterised'").collect()}
    assert len(got) > 15 and set(got) == {k for k, v in want.items() if v >= 0.8}
    broken = OTHER.replace("while Carol", "while Dave")
    bench, docs = frame([(1, ITEM.split())], "item_id"), frame([(1, f"{broken} . and {OTHER}".split()), (2, f"{OTHER} . and {broken}".split()), (3, broken.split())], "doc_id")
    assert {(r["doc_id"], r["template"]) for r in leaks(docs, bench).collect()} == {(1, 1.0), (2, 1.0)}


def test_long_texts_that_hold_a_benchmark(spark):
    items = [(i, " ".join(f"q{i}x{chr(97 + k)}" for k in range(20))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = " ".join(t for _, t in items)
    docs = spark.createDataFrame([(1, f"{whole} {'word ' * 200_000} {whole}"), (2, "word " * 100_000 + items[7][1])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in leaks(docs, bench).collect())
    assert got == [(1, i, "verbatim") for i in range(40)] + [(2, 7, "verbatim")]


def test_names_that_open_a_sentence(spark):
    item = "Tom has 12 apples. Ann has 7 pears. Tom gives Ann 3 apples. How many apples does Ann have?"
    copy = item.replace("Tom", "Bob").replace("Ann", "Eve").replace("12", "15")
    longer = "Mr. Smith met Ann Lee and gave 3 coins to her while Mr. Smith kept 9 coins at home"
    bench = spark.createDataFrame([(1, item), (2, longer)], "item_id long, text string")
    texts = [
        (1, copy), (2, "Foo\n" + copy.replace("Bob", "Mary Jane") + "\nBar"), (3, copy.replace("gives Eve", "gives\nEve")), (4, copy.replace("Eve has", "Bob has")),
        (5, longer.replace("Smith", "Jones").replace("Ann Lee", "\nKim")), (6, copy.replace("How many", "how many").replace("Bob", "Tom")), (7, item.lower()),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leaks(docs, bench).collect()}
    again = "reparameterised"
    assert got == {(1, 1, again), (2, 1, again), (3, 1, again), (5, 2, again), (6, 1, again), (7, 1, "verbatim")}


def test_numbers_that_coincide(spark):
    item = "In the shop Alice bought 3 pens and 5 books and then she gave all of them to the teacher of her class"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("3", "4").replace("5", "4")), (2, item.replace("Alice", "Carol").replace("3", "8"))], "doc_id long, text string")
    assert {(r["doc_id"], r["kind"]) for r in leaks(docs, bench).collect()} == {(1, "reparameterised"), (2, "reparameterised")}


# ---- chat formatting


def test_tool_calls(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "string", "enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}
    call = lambda i, args, deps=(): {"id": i, "name": "f", "arguments": args, "depends_on": list(deps)}
    rows = [
        (1, 0, "system", json.dumps({"content": "s", "tools": [{"name": "f", "parameters": schema}]})),
        (1, 1, "user", 'hi "q"\n'),
        (1, 2, "assistant", json.dumps({"content": "c", "tool_calls": [call("2", {"b": "x", "a": 1}, ["1"]), call("1", '{"z": 1, "a": "no"}'), call("1", {})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "1", "content": {"z": 1, "a": [2.50]}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "2", "content": "done"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "9", "content": None})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("a", {"a": 1}, ["b"]), call("b", {"a": 1, "b": "q"}, ["a"])]})),
        (3, 0, "assistant", '{"tool_calls": broken'),
        (None, None, None, None),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string")
    out = format_chats(messages).orderBy("conv_id", "anchor_turn", "level", "call_index", "kind_rank", "turn").collect()
    first = [(r["kind"], r["call_id"], r["linked_turn"], r["status"], r["errors"]) for r in out if r["conv_id"] == 1]
    assert first == [
        ("message", None, None, "ok", []), ("message", None, None, "ok", []), ("message", None, None, "ok", []),
        ("call", "1", 3, "ok", ["invalid:a", "unexpected:z"]), ("result", "1", 2, "ok", []), ("call", "1", None, "duplicate", ["missing:a"]),
        ("call", "2", 4, "ok", []), ("result", "2", 2, "ok", []), ("result", "9", None, "orphan", []),
    ]
    assert [r["status"] for r in out if r["conv_id"] == 2 and r["kind"] == "call"] == ["unordered", "unordered"]
    texts = {(r["conv_id"], r["kind"], r["call_id"]): r["json"] for r in out}
    assert texts[(1, "call", "2")] == '{"arguments":{"a":1,"b":"x"},"depends_on":["1"],"id":"2","name":"f","type":"call"}'
    assert texts[(1, "result", "1")] == '{"content":{"a":[2.5],"z":1},"id":"1","type":"result"}'
    assert json.loads(texts[(3, "message", None)])["content"] == '{"tool_calls": broken'
    assert texts[(None, "message", None)] == '{"content":"","role":"unknown","type":"message"}'
    tools = spark.createDataFrame([("f", json.dumps(schema))], "name string, parameters string")
    errors = [r["errors"] for r in format_chats(messages, tools).where("conv_id = 2 and kind = 'call'").orderBy("call_index").collect()]
    assert errors == [[], ["invalid:b"]]
    assert format_chats(messages.limit(0)).count() == 0


def test_repeated_calls_do_not_multiply(spark):
    said = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {}, "depends_on": []}, {"id": "b", "name": "f", "arguments": {}, "depends_on": ["a"]}, {"id": None, "name": "f", "arguments": {}}]})
    rows = [(1, 0, "assistant", said)] * 3 + [(1, 1, "tool", json.dumps({"tool_call_id": "b", "content": 1}))] * 2 + [(None, 0, "assistant", said), (1, None, "tool", json.dumps({"tool_call_id": "a", "content": "first"}))]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    made = sorted((r["conv_id"] or 0, r["call_id"] or "", r["kind"], r["level"], r["status"]) for r in out if r["kind"] != "message")
    one = [(1, "", "call", 0, "unnamed"), (1, "a", "call", 0, "ok"), (1, "b", "call", 1, "ok")]
    assert made == sorted([*one * 3, *[(1, "b", "result", 1, "ok")] * 2, (1, "a", "result", 0, "ok"), *[(0, x, "call", 0, "unnamed") for x in ("", "a", "b")]])
    assert sum(r["kind"] == "message" for r in out) == 4


def test_long_texts_and_lists_of_types(spark):
    schema = {"properties": {"a": {"type": ["string", "null"]}, "b": {"type": "strange"}}}
    tools = spark.createDataFrame([("f", json.dumps(schema))], "name string, parameters string")
    given = [{"a": None, "b": 1}, {"a": "x"}, {"a": 1}, {"a": "y" * 1_000_000}]
    calls = [{"id": str(i), "name": "f", "arguments": a} for i, a in enumerate(given)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (1, 1, "user", "long " * 200_000)]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    assert {r["call_id"]: r["errors"] for r in out if r["kind"] == "call"} == {"0": [], "1": [], "2": ["invalid:a"], "3": []}
    assert max(len(r["json"]) for r in out if r["kind"] == "message") > 1_000_000


@pytest.mark.parametrize(("run", "wide"), [(1024, 64), (5, 64), (1, 1)])
def test_levels_match_brute_force(spark, monkeypatch, run, wide):
    """Random dependencies, circles and missing ones among them: in one row, in runs of turns, and peeled."""
    monkeypatch.setattr(chat_module, "RUN", run)
    monkeypatch.setattr(chat_module, "WIDE", wide)
    rng, rows, want = random.Random(9), [], {}
    for conv in range(12):
        calls = [(turn, f"{turn}.{k}") for turn in range(rng.randrange(1, 14)) for k in range(rng.randrange(0, 4))]
        pools = {i: [j for t, j in calls if turn - 4 < t <= turn + (rng.random() < 0.01) and j != i and (t < turn or rng.random() < 0.3)] + ["none"] * (rng.random() < 0.04) for turn, i in calls}
        needs = {i: rng.sample(pool, k=min(rng.choice((0, 1, 1, 2)), len(pool))) for i, pool in pools.items()}
        turn_of, level = {i: t for t, i in calls}, {}
        for _ in calls:
            level |= {i: 1 + max((level[j] for j in needs[i]), default=-1) for _, i in calls if all(j in level and turn_of[j] <= turn_of[i] for j in needs[i])}
        want |= {(conv, i): level.get(i) for _, i in calls}
        for turn in sorted({t for t, _ in calls}):
            own = [{"id": i, "name": "f", "arguments": {}, "depends_on": needs[i]} for t, i in calls if t == turn]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": own})))
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert {(r["conv_id"], r["call_id"]): None if r["status"] == "unordered" else r["level"] for r in out} == want
    assert max(x or 0 for x in want.values()) > 3 and None in want.values()


def test_long_chain_of_calls_is_ordered(spark):
    chain = [{"id": str(i), "name": "f", "arguments": {}, "depends_on": [str(i + 1)] if i < 5 else []} for i in range(6)]
    messages = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": chain}))], "conv_id long, turn long, role string, text string")
    calls = format_chats(messages).where("kind = 'call'").orderBy("level").collect()
    assert [r["call_id"] for r in calls] == ["5", "4", "3", "2", "1", "0"]


# ---- packing


def test_boundaries_match_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)

        def padded(ends):
            return sum(n * min(e for e in ends if e >= x) for x, n in zip(lengths, counts, strict=True))  # noqa: B023

        best = min(padded([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        ends = boundaries(np.array(lengths, dtype=float), np.array(counts), k)
        assert padded(ends) == best and len(ends) <= k and ends[-1] == lengths[-1]
    assert boundaries([], [], 4) == []


def test_boundaries_of_many_lengths_match_the_full_programme():
    rng = random.Random(8)
    lengths = sorted(rng.sample(range(20_000), 700))
    counts = [rng.choice((1, 1, 3, 90, 2000)) for _ in lengths]
    rows = np.concatenate([[0], np.cumsum(counts)])
    cost = np.array([0.0] + [np.inf] * len(lengths))
    for _ in range(16):
        total = cost[:, None] + (rows[None, 1:] - rows[:, None]) * np.array(lengths, dtype=float)[None, :]
        total[np.arange(701)[:, None] > np.arange(700)[None, :]] = np.inf
        cost = np.concatenate([[0.0], total.min(axis=0)])
    ends = boundaries(lengths, counts, 16)
    assert len(ends) == 16 and sum(c * min(e for e in ends if e >= x) for x, c in zip(lengths, counts, strict=True)) == cost[-1]


def packed_by_hand(texts, buckets, budget, part):
    """(doc_id, n_tokens, bucket, batch, slot) of every row, with all choices of buckets tried."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = []
    for i, t in texts:
        n = len((t or "").split())
        rows.append((int(md5(f"{'' if i is None else i}/{md5(t or '')}")[:15], 16), i, n + 1 if n else 0))
    lengths = sorted({r[2] for r in rows})
    choices = ([*c, lengths[-1]] for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
    ends = min(choices, key=lambda e: (sum(min(x for x in e if x >= r[2]) for r in rows), e[::-1]))
    heavy = {o for o, n in Counter(r[0] for r in rows).items() if n > part}
    parts = -(-len(rows) // part)
    key = lambda r: ((r[0] >> 28) * parts >> 32, r[0] in heavy, r[0], str(r[1]), r[2])
    out = []
    for end in ends:
        own = sorted((r for r in rows if min(x for x in ends if x >= r[2]) == end), key=key)
        each = max(1, budget // max(end, 1))
        out += [(r[1], r[2], end, k // each, k % each) for k, r in enumerate(own)]
    return out


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_pack_matches_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(packing_module, "PART", part)  # small parts: ranks go on across them, equal rows in several
    rng = random.Random(4)
    texts = [(i, " ".join(["w"] * rng.randrange(0, 25))) for i in range(300)] + [(300, None), (None, "a b"), (5, "w " * 3000), (5, "w " * 3000)]
    texts += [(400, "a b c")] * 40 + [(None, None)] * 30
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, bucket int")
    rows = [tuple(r) for r in pack(docs, buckets=3, budget=256).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(rows, key=order) == sorted(packed_by_hand(texts, 3, 256, part), key=order)
    assert pack(docs.limit(0)).count() == 0


# ---- sharding


def test_shards_fit(spark):
    rng = random.Random(6)
    texts = [(i % 900, "é" * rng.randrange(0, 400)) for i in range(1000)] + [(5000, "x" * 20_000), (None, None)] + [(7000, "y" * 3000)] * 6
    docs = spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, shard string")
    rows = shards(docs, limit=10_000).collect()
    assert len(rows) == len(texts) and sum(r["n_bytes"] for r in rows) == sum(len((t or "").encode()) for _, t in texts)
    total, names = defaultdict(int), set()
    for r in rows:
        total[r["shard"]] += r["n_bytes"]
        names.add(r["shard"])
    assert all(total[r["shard"]] == r["shard_bytes"] and r["fits"] == (r["shard_bytes"] <= 10_000) for r in rows)
    assert {r["shard"] for r in rows if not r["fits"]} == {r["shard"] for r in rows if r["doc_id"] in (5000, 7000) and r["n_bytes"] > 2000}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # leaves of one directory
    assert all(len({r["doc_id"] for r in rows if r["shard"] == n}) == 1 for n in {r["shard"] for r in rows if not r["fits"]})
    for name in names:  # only buckets that were too large have split
        if name:
            assert sum(v for k, v in total.items() if k.startswith(name[:-1])) > 10_000
    assert shards(docs.limit(0)).count() == 0
    assert {r["shard"] for r in shards(docs.limit(5)).collect()} == {""}


# ---- pipeline


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def pipeline_by_hand(spark, rows, good):
    """The (doc_id, text) rows left by each filtering stage, by plain loops over all rows."""
    stages = [[(i, t) for i, t in rows if i in good]]
    groups = defaultdict(list)
    for i, t in stages[-1]:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i, t))
    stages.append([min(g)[1:] for g in groups.values()])
    sets, root = {i: shingles(t) for i, t in stages[-1]}, {i: i for i, _ in stages[-1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        common.update(itertools.combinations(sorted(ids), 2))
    for (x, y), n in common.items():
        if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n) and (p := top(x)) != (q := top(y)):
            root[max(p, q)] = min(p, q)
    stages.append([(i, t) for i, t in stages[-1] if top(i) == i])
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [g for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if (g := grams(tokens(r["text"])))]
    stages.append([(i, t) for i, t in stages[-1] for own in [grams(tokens(t))] if not any(len(g & own) >= 0.8 * len(g) for g in items)])
    return stages


def test_pipeline_matches_brute_force(spark):
    """Every stage's rows and the last one's batches against loops; the classifier's decisions are those of its query."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in registry.queries()["op8_quality"](spark, SF).where("predicted = 1").collect()}
    wanted, kept = pipeline_by_hand(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], good), docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        before = {tuple(r) for r in kept.collect()}
        kept = staged(stage(spark, kept, SF))
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= before
        got = {tuple(r) for r in kept.select("doc_id", "text").collect()}
        if name != "decontamination":
            assert got == set(want) and kept.count() == len(want), name
        else:  # re-parameterised copies, which the loops don't know, go as well; each has a test of its own
            also = {r["doc_id"] for r in registry.queries()["op2_template_decontamination"](spark, SF).where("kind = 'reparameterised'").collect()}
            assert got == {(i, t) for i, t in want if i not in also}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = dict(got)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows) and len(rows) == len(texts)
    alike = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    columns = ["doc_id", "n_tokens", "bucket", "batch", "slot"]
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(tuple(r[c] for c in columns) for r in pack(alike).collect())


def test_pipeline_releases_what_it_stages(spark):
    import os

    from scanloom.llm.common import staging_folder

    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    folder = staging_folder(spark).removeprefix("file://")
    inside = {f for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and d != folder}
    before = len(os.listdir(folder))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert inside and len(os.listdir(folder)) - before <= 6  # the last filter's rows and the last stage's own tables


def test_pipeline_on_odd_rows(spark, tmp_path):
    odd = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "some plain words here", "en", "s", 3), (4, "a b c", None, None, None), (4, "a b c", None, None, None), (5, "long " * 300_000, "en", "s", 1)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {4, 5} and len(out) >= 4
    # extra columns with the names of the operators' own stay as they are
    extra = ["score", "label", "bucket", "row", "a", "b", "id", "key", "item_id", "kept", "dropped_id", "leaking_id"]
    wide = rows.select("*", *(F.col("n_chars").alias(c) for c in extra))
    wide.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == wide.columns and docs.where("not score <=> n_chars or not kept <=> n_chars").count() == 0
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in out)
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_rows_reach_the_classifier_in_small_batches(spark, tmp_path):
    """Rows of 100 kB, 20 MB in one task: the worker gets some 2 MB of them at once, and the same rows stay."""
    from scanloom.llm.common import ARROW_BYTES, ROWS_AT_ONCE

    rows = [(i, f"row {i} of plain words. " * 5000) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset(ARROW_BYTES)  # stages that other tests call alone leave it small
    before = spark.conf.get(ARROW_BYTES)
    try:
        wide = docs.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
        narrow = docs.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        got = sorted(r["doc_id"] for r in kept.collect())
        spark.conf.set(ARROW_BYTES, before)
        assert got == sorted(r["doc_id"] for r in kept.select("*").collect())
    finally:
        spark.conf.set(ARROW_BYTES, before)
    longest = max(len(t) for _, t in rows)
    assert wide > 8 * ROWS_AT_ONCE and longest < narrow < ROWS_AT_ONCE + 2 * longest
    corpus_pipeline.run(spark, SF)
    assert spark.conf.get(ARROW_BYTES) == before
