"""Cases of the operators and the stages: nulls, ties, repeated rows, hot keys, very long texts, clashing names."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import chat_format, common, decontamination, jaccard_join, packing, pii, secret_scan, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- 1 -----------------------------------------------------------------------


def test_templates_are_bounded():
    nested = "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}"
    deep = "{% if a %}" * 100 + "{% endif %}" * 100
    for bad in ("{{ '%5000000d' % 1 }}", "{{ 'ab' * 5000000 }}", "{% generation %}{% generation %}a{% endgeneration %}{% endgeneration %}", nested, deep, "{{ " + "not " * 5000 + "a }}", "{{ none | length }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)
    for bad in ("{{ x | length }}", "{{ x + 1 }}", "{{ x < 1 }}", "{{ 1 % 0 * y }}", "{% for a in y %}{% endfor %}", "{{ 'a' in x }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)({"x": None, "y": 3})
    assert chat_format.compile_template("{{ 7 % 4 * 2 - 1 }}")({})[0] == "5"


# --- 3 -----------------------------------------------------------------------


def test_pii_of_very_many_matches(spark):
    many = "a@b.c " * 160_000
    docs = spark.createDataFrame([(1, many), (2, "x@y.z")], "doc_id bigint, text string")
    start = time.perf_counter()
    found = {r["doc_id"]: r for r in pii.find(docs, None).select("doc_id", F.size("email").alias("n"), F.element_at("email", -1).alias("last")).collect()}
    assert time.perf_counter() - start < 60
    assert found[1]["n"] == 160_000 and (found[1]["last"]["start"], found[1]["last"]["stop"]) == (6 * 159_999, 6 * 159_999 + 5)
    assert found[2]["n"] == 1


# --- 4 -----------------------------------------------------------------------


def test_a_common_preamble_is_no_leak(spark):
    preamble = "Read the following question with great care and then choose the best of the four answers that are given below"
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    bench = spark.createDataFrame([(k, f"{preamble} {words(k)}") for k in range(60)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, preamble + " and nothing else"), (2, f"So: {preamble} {words(7)}"), (3, words(9))], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(2, 7): 40, (3, 9): 20}
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()} == {1}
    # Items that have no window of their own are still found, and equal texts are reported under each id.
    alike = spark.createDataFrame([(k, preamble) for k in range(40)], "item_id bigint, text string")
    assert decontamination.leaks(docs, alike).count() == 80


def test_names_at_the_start_of_sentences(spark):
    item = "Sue ran 5 miles on Monday and came home late. Sue ran 3 miles on Friday."
    texts = {1: item.replace("Sue", "Ann"), 2: f"well, {item}", 3: item.lower(), 5: "It was so, " + item[0].lower() + item[1:]}
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.leaks(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), bench).collect()}
    assert {1, 2, 3, 5} <= set(got) and got[1]["reparameterised"] and not got[2]["reparameterised"]
    assert got[1]["covered_words"] == 14  # the window that starts with the first name has too few literal words


def test_inconsistent_slots_do_not_count(spark):
    item = "The old mill grinds 12 sacks before noon while the new mill grinds 12 sacks after noon"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item.replace("12", "40")), (2, item.replace("12 sacks before", "40 sacks before").replace("12 sacks after", "55 sacks after"))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["covered_words"] for r in decontamination.leaks(docs, bench).collect()}
    assert got[1] == 17 and got.get(2, 0) < 17


def test_leaks_in_very_long_texts_and_ties(spark):
    item = "what is the name of the river that runs through the town of the seven gates and the old bridge"
    long = "filler words " * 200_000 + item + " more words" * 100_000
    docs = spark.createDataFrame([(1, long), (1, long), (1, item), (2, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"], r["covered_words"]) for r in decontamination.leaks(docs, bench).collect()] == [(1, 1, 20)]


# --- 6 -----------------------------------------------------------------------


def test_packing_of_one_hot_id(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack_documents(rows, docs_per_group=1000)
    totals = got.agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.count_distinct(F.floor(F.col("bin_id") / (1 << 32))).alias("groups")).first()
    assert (totals["n"], totals["rows"]) == (120_000, 30_000) and totals["groups"] > 15


def test_joint_lengths_cost_less_than_any_one():
    random.seed(3)
    steep = lambda x: x + x * x / 8192 + 200
    for cost in (packing.sequence_cost, steep):
        for _ in range(20):
            sizes = sorted((int(random.lognormvariate(5.5, 1.2)) % 1024 + 1 for _ in range(400)), reverse=True)
            joint = sum(map(cost, packing.cheapest(sizes, packing.LENGTHS, cost)[2]))
            singles = [sum(map(cost, packing.pack(sizes, (x,), cost)[2])) for x in packing.LENGTHS[1:]]  # each holds every piece
            assert joint <= min(singles) and joint < max(singles) * 0.99


def test_packing_is_near_the_optimum_on_small_cases():
    lengths, cost = (4, 8), lambda x: x + 1

    def best(sizes: tuple[int, ...], rooms: tuple[int, ...] = ()) -> float:
        """The least cost by trying every bin for every piece; ``rooms`` are the loads of open bins."""
        if not sizes:
            return sum(cost(min(x for x in lengths if x >= load)) for load in rooms)
        s, rest = sizes[0], sizes[1:]
        loads = [(*rooms[:i], r + s, *rooms[i + 1 :]) for i, r in enumerate(rooms) if r + s <= max(lengths)]
        return min(best(rest, tuple(sorted(x))) for x in [*loads, (*rooms, s)])

    random.seed(4)
    ratios = []
    for _ in range(60):
        sizes = sorted((random.randint(1, 8) for _ in range(6)), reverse=True)
        ratios.append(sum(map(cost, packing.pack(sizes, lengths, cost)[2])) / best(tuple(sizes)))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.03 and max(ratios) < 1.35


# --- 7 -----------------------------------------------------------------------


def test_secret_spans_of_very_many_candidates():
    text = 'token = "abcdef12" and Xk29mQp4Lw8Zr1 ' * 30_000
    start = time.perf_counter()
    spans = secret_scan.base_spans(text)
    free = secret_scan.uncovered(spans, secret_scan.candidates(text))
    assert time.perf_counter() - start < 20
    assert len(spans) == 30_000 and sum(text[a:b] == "Xk29mQp4Lw8Zr1" for a, b in free) == 30_000
    random.seed(2)
    for _ in range(500):
        spans = sorted((("assign", a, a + random.randint(1, 9)) for a in (random.randrange(60) for _ in range(random.randrange(6)))), key=lambda s: s[1])
        ends = sorted(random.sample(range(80), 2 * random.randrange(1, 8)))
        runs = list(zip(ends[::2], ends[1::2], strict=True))
        assert secret_scan.uncovered(spans, runs) == [(a, b) for a, b in runs if not any(x < b and a < y for _, x, y in spans)]


def test_hidden_kinds_of_secrets(spark):
    """Keys in forms that no pattern knows, none of which is in training: found with a recall of 0.9, few others."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(3, 12)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(random.choice(letters) for _ in range(n))
    known = [(i, f"{word()} {word()} api_key: {key(random.choice([16, 24, 32, 40]))} {word()} no {random.randrange(10**12)} {word()}-{word()}") for i in range(400)]
    hidden = [(1000 + i, f"{word()} {word()} {random.choice(['ghx_', 'sk-', 'pat/', ''])}{key(random.randint(20, 50))} {word()}") for i in range(100)]
    clean = [(2000 + i, " ".join(word() for _ in range(20)) + f" {word()}-{word()} 2024-01-{i % 28 + 1:02d} {random.randrange(10**9)}") for i in range(200)]
    docs = spark.createDataFrame([*known, *hidden, *clean], "doc_id bigint, text string")
    net = secret_scan.train(docs.filter("doc_id < 1000"))
    rows = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "model"] for r in secret_scan.scan(docs, net).collect()}
    caught = sum(bool(rows[i]) for i, _ in hidden)
    wrong = sum(len(rows[i]) for i, _ in clean)
    assert caught >= 90 and caught / (caught + wrong) >= 0.9


# --- 8 -----------------------------------------------------------------------


def test_margins_are_the_sum_over_pairs():
    random_ = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(30), 0.3, random_.normal(size=30), random_.normal(size=(30, 4)))
    rows = [np.sort(random_.choice(30, k, replace=False)) for k in (0, 1, 2, 7, 30)]
    got = machine.margins(np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows).astype(np.int64), len(rows))
    want = [0.3 + sum(machine.w[i] for i in r) + sum(machine.v[i] @ machine.v[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(got, want)


def test_pairs_without_any_effect_of_their_own(spark):
    """Toxic if just one of two words is there: neither tells anything alone, and no linear weights can say it."""
    random.seed(7)
    rows, labels = [], []
    for i in range(2400):
        a, b = random.random() < 0.5, random.random() < 0.5
        words = [*(["gubbins"] if a else []), *(["klingon"] if b else []), *[f"w{random.randrange(30)}" for _ in range(5)]]
        rows.append((i, " ".join(random.sample(words, len(words)))))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, marks)
    got = toxicity.score(docs, machine).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert got.filter("predicted = toxic").count() / got.count() > 0.95
    plain = toxicity.Machine(machine.terms, machine.bias, machine.w, 0 * machine.v)
    flat = toxicity.score(docs, plain).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert flat.filter("predicted = toxic").count() / flat.count() < 0.8


# --- 9 -----------------------------------------------------------------------


def test_buckets_follow_the_bytes():
    assert jaccard_join.buckets_of(0) == 8 and jaccard_join.buckets_of(1 << 30) == 128
    assert jaccard_join.buckets_of(50 << 30) == 256 and jaccard_join.buckets_of(100 << 40) >= 1 << 18


def test_packed_classes_come_back():
    names, numbers = np.array([5, 2**63 + 1], np.uint64), np.array([7, 70_000])
    assert [x.tolist() for x in jaccard_join._unpacked(jaccard_join._packed(names, numbers))] == [names.tolist(), numbers.tolist()]


def test_many_ranges_of_one_bucket(spark, monkeypatch):
    """Buckets that are counted range by range give the same as at once, and long texts are read whole."""
    random.seed(5)
    rows = [(i, " ".join(f"w{random.randrange(9)}" for _ in range(60))) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{j}" for j in range(3000 + 20 * i))) for i in range(6)] + [(200, "long " * 400_000), (201, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, jaccard_join.join(docs).collect()))
    monkeypatch.setattr(jaccard_join, "RANGE", 500)
    assert sorted(map(tuple, jaccard_join.join(docs).collect())) == want
    of = {d: c for d, _, c in want}
    assert of[201] == of[200] == 200 and {of[100 + i] for i in range(6)} == {100}


# --- rows and stages ---------------------------------------------------------


def test_rows_have_numbers_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "doc_id bigint, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "d"))
    for rows in (docs, spark.read.parquet(str(tmp_path / "d"))):
        got = common.numbered(rows, "k")
        assert got.columns == ["doc_id", "text", "k"] and sorted(r["k"] for r in got.collect()) == [0, 1, 2, 3]
    assert common.numbered(spark.read.parquet(str(tmp_path / "d")).limit(0), "k").count() == 0


def _texts():
    random.seed(20)
    words = lambda k, n=40: " ".join(f"w{k}y{random.Random(k * 1000 + j).randrange(10**6)}" for j in range(n))
    return words


@pytest.fixture
def odd_docs(spark):
    words = _texts()
    rows = [(1, words(1)), (1, words(1)), (1, words(1)), (5, words(1)), (5, words(2)), (None, words(3)), (None, words(3)), (None, None), (7, ""), (7, ""), (8, "long " * 200_000)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS), words


def test_near_copies_are_dropped_row_by_row(spark, odd_docs):
    docs, words = odd_docs
    kept = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001")
    got = sorted((r["doc_id"] or -1, (r["text"] or "")[:8]) for r in kept.collect())
    first = [r for r in got if r[1] == words(1)[:8]]
    assert kept.columns == docs.columns and len(first) == 1
    assert sorted(r for r in got if r not in first) == sorted([(5, words(2)[:8]), (-1, words(3)[:8]), (-1, ""), (7, ""), (7, ""), (8, "long lon")])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_leaks_are_dropped_row_by_row(spark, tmp_path, odd_docs):
    docs, words = odd_docs
    spark.createDataFrame([(1, words(2)), (2, words(3))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:4]) for r in kept.collect()) == sorted([(1, "w1y" + words(1)[3]), (1, "w1y" + words(1)[3]), (1, "w1y" + words(1)[3]), (5, "w1y" + words(1)[3]), (-1, ""), (7, ""), (7, ""), (8, "long")])


def test_the_other_stages_on_odd_rows(spark, tmp_path, odd_docs):
    docs, _ = odd_docs
    clash = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit("p"), "spans": F.lit("x"), "group": F.lit("g"), "part": F.lit("y")})
    marks = [(i, i % 2) for i in range(100, 160)]
    texts = spark.createDataFrame([(i, "vile gubbins here" if t else "a fine day", "en", "s", 10) for i, t in marks for _ in range(2)], DOCS)
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    every = clash.unionByName(texts, allowMissingColumns=True)
    kept = corpus_pipeline.drop_toxic(spark, every, str(tmp_path))
    assert kept.columns == every.columns and kept.filter("score = 'mine' and predicted = 'p'").count() == docs.count()
    assert kept.filter("doc_id >= 100").select("doc_id").distinct().count() == 30
    hidden = corpus_pipeline.hide_secrets(spark, clash, str(tmp_path))
    assert hidden.columns == clash.columns and sorted(map(tuple, hidden.collect()), key=str) == sorted(map(tuple, clash.collect()), key=str)
    packed = corpus_pipeline.pack(spark, clash, str(tmp_path))
    assert packed.select("doc_id", "bin_id", "start").distinct().count() == packed.count()
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.hide_secrets, corpus_pipeline.pack):
        assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0


def test_toxicity_is_not_trained_on_the_driver(spark, monkeypatch):
    import os

    driver, fitted = os.getpid(), toxicity.train

    def elsewhere(*args):
        assert os.getpid() != driver
        return fitted(*args)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    docs = spark.createDataFrame([(i, f"vile words {i}" if i % 2 else f"kind words {i}") for i in range(90)], "doc_id bigint, text string")
    assert toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))) is not None


def test_trees_learn_from_all_documents(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to a"), F.col("id").cast("string"), F.lit("@b.org or room 12345678")).alias("text"))
    rows = pii.training_rows(docs)
    assert rows.filter("label = 1").agg(F.sum("weight")).first()[0] == 60_000
    assert rows.filter("label = 0").agg(F.sum("weight")).first()[0] == 20_000
    assert rows.count() < 500


def test_findings_are_those_of_all_documents(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("AKIA"), F.lpad(F.col("id").cast("string"), 16, "X"), F.lit(" but not runner"), F.col("id").cast("string")).alias("text"))
    found = {r["label"]: r["n"] for r in secret_scan.findings(docs).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert found == {0: 21_000, 1: 21_000}


def test_parts_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "PART", 500)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("the key AKIA"), F.substring(F.upper(F.sha1(F.col("id").cast("string"))), 1, 18), F.lit(" but not run"), F.col("id").cast("string")).alias("text"))
    net = secret_scan.train(docs)
    assert secret_scan.train(docs.repartition(7)).threshold == net.threshold
    shown = spark.createDataFrame([(1, "the key 7F3A90BC11DE42A7C9 but not run5")], "doc_id bigint, text string")
    assert [(s["kind"], s["start"], s["end"]) for s in secret_scan.scan(shown, net).first()["spans"]] == [("model", 8, 26)]
