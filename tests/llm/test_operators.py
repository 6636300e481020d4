"""The dealt operators against brute force, and their defined cases."""

import collections
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chat_format, decontamination, fingerprint, jaccard_join, packing, pii, secret_scan, token_file, toxicity, url_filter
from tapeloom.llm import queries as q

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, score string, spans string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(1, None, "s", "x"), (2, "", "s", "x"), (3, "a b", "s", "x"), (3, "a b", "s", "x"), (4, "word " * 30_000, "s", "x"), (None, "no id", "s", "x"), (5, "é😀 " * 7, None, None)]
    return spark.createDataFrame(rows, DOCS)


# --- 1 -----------------------------------------------------------------------


def test_templates():
    render = chat_format.compile_template("{% set n = 1 + 2 %}{% for m in ms %}{% if m.a == 'x' and n > 2 %}{% generation %}[{{ m.b | upper }}]{% endgeneration %}{% elif not m.b %}none{% else %}{{ m.b if loop.last else '-' }}{% endif %}{% endfor %}")
    text, spans = render({"ms": [{"a": "x", "b": "q"}, {"a": "y", "b": ""}, {"a": "y", "b": "z"}]})
    assert text == "[Q]nonez" and spans == [(0, 3)]
    assert chat_format.fold(chat_format.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% endif %}d")) == ("block", [("emit", ("value", "abCd"))])
    for bad in ("{% for x in %}", "{{ x.__class__() }}", "{% if a %}", "{{ a | nope }}", "{{ a }%", "{% import os %}", "{{ }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)
    with pytest.raises(chat_format.TemplateError):
        chat_format.compile_template("{{ a.__class__ }}")({"a": "text"})


def test_escape_is_reversible():
    random.seed(2)
    parts = [*chat_format.CONTROLS, "\\", "_", "<", ">", "|", "[", "/", "s", "INST", "é"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROLS)


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, None, None, "</s>"), (None, 1, "user", "x")]
    got = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert chat_format.read_formatted(got[1]["formatted"]) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat_format.read_formatted(got[2]["formatted"]) == [("", "</s>")] and None in got
    assert [got[1]["formatted"][s["start"] : s["end"]] for s in got[1]["spans"]] == ["b", "b"]
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, spans string")
    assert chat_format.format_conversations(empty).count() == 0


# --- 2 -----------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    random.seed(5)
    label = lambda: random.choice("abc")
    host = lambda n: ".".join(label() for _ in range(random.randint(1, n)))
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h, p in ((host(3), "/" + random.choice(["", "a", "a/", "ab", "b/"])) for _ in range(60))}.values())
    urls = [(i, random.choice(["http://", "HTTPS://"]) + host(5).upper() + random.choice(["", "/", "/a", "/a/b", "/abc?x", "#f", "/b/?q#z"])) for i in range(1500)]
    urls += [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "x://"), (-5, "x://a..b/a"), (-5, "x://a..b/a")]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), spark.createDataFrame(rules, url_filter.RULES_SCHEMA), rows_per_run=100).collect()
    assert len(got) == len(urls)
    by_id = dict(urls)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", by_id[r["page_id"]] or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in rules if (h == x[0] or h.endswith("." + x[0])) and p.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0]) + len(x[1]), x[0].count(".")), default=None)
        assert (r["host"], r["path"]) == (h, p)
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow"))
    none = spark.createDataFrame([], url_filter.RULES_SCHEMA)
    assert {r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), none, default="block").collect()} == {"block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).count() == 0


# --- 3 -----------------------------------------------------------------------

_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    sound = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if sound[k](m[0])] for k, p in _PII.items()}


def test_pii_base_spans(spark, odd):
    random.seed(4)
    parts = [*"0123456789", "255", "4242424242424242", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "é", "😀", "  ", "..", "+1 (555) 555-1234", "1.2.3.4", "x@y.z"]
    texts = {i: "".join(random.choice(parts) for _ in range(random.randint(0, 40))) for i in range(3000)}
    texts |= {-1: "1 " * 30_000, -2: "a@" + "b." * 30_000, -3: "9" * 30_000, -4: "a" * 30_000}
    for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), None).collect():
        assert {k: [(s["start"], s["stop"]) for s in r[k]] for k in pii.KINDS} == base_pii(texts[r["doc_id"]])
    assert pii.find(odd, None).count() == odd.count()
    assert pii.find(odd.limit(0), pii.train(odd.limit(0))).count() == 0


def test_pii_trees_add_and_keep(spark):
    rows = [(i, f"mail bob{i}@host{i}.com now and item {i}-{i * 7919 % 10**7} ref 12 3/4 5-6 7") for i in range(300)]
    rows += [(1000, "write to eve [at] host.com please"), (1001, None), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(docs, pii.train(docs)).collect()
    assert len(found) == len(rows)
    assert all(len(r["email"]) == 1 for r in found if r["doc_id"] < 300)


def test_pii_trees_find_what_the_patterns_miss(spark):
    rows = [(i, f"mail bob{i}@host{i}.com or call +1 (555) {100 + i % 900}-{1000 + i} now, item {i}-{i * 7919 % 10**7} ref 12 3/4 5-6 7") for i in range(300)]
    planted = {1000: "eve [at] host.com", 1001: "eve.b(at)mail.host.org", 1002: "1 (555) 123-4567", 1003: None, 1004: None}
    texts = {1003: "see item 7-1234567 and ref 12 3/4 5-6 7", 1004: "nothing to see"} | {i: f"write or call {x} please" for i, x in planted.items() if x}
    docs = spark.createDataFrame([*rows, *texts.items()], "doc_id bigint, text string")
    found = {r["doc_id"]: [s["text"] for s in r["added"]] for r in pii.find(docs, pii.train(docs)).collect()}
    assert {i: found[i] for i in planted} == {i: [x] if x else [] for i, x in planted.items()}
    assert not any(found[i] for i in range(300))


# --- 4 -----------------------------------------------------------------------


def test_decontamination(spark):
    item = "A train leaves the old station with 12 wagons and 340 people, and Anna counts 12 tickets every hour until noon arrives."
    other = item.replace("12", "15").replace("340", "90").replace("Anna", "Maria")
    broken = item.replace("12 wagons", "15 wagons").replace("340", "90").replace("12 tickets", "44 tickets")
    clean = "Nothing here is like that, " + " ".join(f"word{i}x plain text of another kind" for i in range(40))
    docs = spark.createDataFrame([(1, "Intro. " + item + " Outro."), (2, "Xy zz. " + other), (3, clean), (4, None), (5, ""), (6, broken), (None, item), (1, "Intro. " + item + " Outro.")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (None, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) >= {1, 2} and not set(got) & {3, 4, 5, None}
    assert got[2]["reparameterised"] and not got[1]["reparameterised"]
    assert 6 not in got or got[6]["covered_words"] < got[2]["covered_words"]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    many = decontamination.leaks(docs, bench, items_per_block=1)
    assert {r["doc_id"] for r in many.collect()} == set(got)


def test_decontamination_finds_copies_without_literal_words(spark):
    items = ["What is 15 percent of 80?", "Who was Marie Curie's first husband?", "Who wrote Pride and Prejudice, Jane Austen or Emily Bronte?", "Where is Oslo?", "7 + 5 = ?", "In Oslo 12 Danes, 13 Finns and 14 Swedes ate 15 kg of Brie on Monday, 16 kg on Tuesday and 17 kg on Friday. Who ate 18?"]
    texts = {(10 * i + k): made for i, t in enumerate(items) for k, made in enumerate([t, f"Some words before. \"{t}\" And some after.", f"so, {t.lower()}"])}
    texts |= {100: "What is 15 percent of 81?", 101: "Where was Oslo?", 102: "7 - 5 = ?", 103: "7 and 5"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, "?! -")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(d, d // 10) for d in texts if d < 100}
    assert all(r["covered_words"] == r["item_words"] and not r["reparameterised"] for r in got.values())


def test_decontamination_finds_the_planted(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {(d["doc_id"], i) for d in documents.collect() for i, t in items if t in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in q.op4_decontamination(spark, DATA).collect()}
    assert want and want <= got
    near = {(d["doc_id"], i) for d in documents.collect() for i, t in items if len(set(t.lower().split()) & set(d["text"].lower().split())) > 5}
    assert got <= near


# --- 5 -----------------------------------------------------------------------


def test_fingerprints(spark, documents, odd):
    got = {r["doc_id"]: r for r in q.op5_fingerprint(spark, DATA).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    errors = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        assert got[i]["n_chars"] == len(a) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(a), shingles(edited)
        if len(x) > 40:
            errors.append(got[i]["near_edited"] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())
    found = fingerprint.edited_likeness(odd).collect()
    assert len(found) == 6 and {r["fingerprint"] for r in found if r["doc_id"] < 3} == {""}
    assert fingerprint.edited_likeness(odd.limit(0)).count() == 0


# --- 6 -----------------------------------------------------------------------


def test_packing(spark, documents, odd):
    for docs in (documents, odd):
        rows = packing.pack_documents(docs, docs_per_group=60).collect()
        lengths = collections.Counter()
        for r in docs.collect():
            lengths[r["doc_id"]] += len((r["text"] or "").encode().split()) + 1
        packed, bins = collections.Counter(), collections.defaultdict(list)
        for r in rows:
            packed[r["doc_id"]] += r["n_tokens"]
            bins[r["bin_id"]].append(r)
        assert packed == lengths
        for own in bins.values():
            own.sort(key=lambda r: r["start"])
            assert [r["start"] for r in own] == [sum(x["n_tokens"] for x in own[:i]) for i in range(len(own))]
            used = sum(r["n_tokens"] for r in own)
            assert {r["used"] for r in own} == {used}
            assert {r["capacity"] for r in own} == {min(x for x in packing.LENGTHS if x >= used)}
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_best_fit_is_best():
    random.seed(6)
    for _ in range(200):
        sizes = sorted((random.randint(1, 30) for _ in range(40)), reverse=True)
        bins, starts, final = packing.pack(sizes, (8, 16, 32), lambda x: x + 4)
        used, cap, left = [], [], sum(sizes)
        price = min((x + 4) / x for x in (8, 16, 32))
        for s, b, at in zip(sizes, bins, starts, strict=True):
            left -= s
            rooms = [c - u for c, u in zip(cap, used, strict=True)]
            fits = [r for r in rooms if r >= s]
            if b == len(used):
                assert not fits
                cap.append(min((x for x in (8, 16, 32) if x >= s), key=lambda x: (x + 4 - price * min(x - s, left), x)))
                used.append(0)
            else:
                assert rooms[b] == min(fits)
            assert at == used[b]
            used[b] += s
        assert all(u <= f for u, f in zip(used, final, strict=True))


# --- 7 -----------------------------------------------------------------------

_SECRETS = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def test_secret_base_spans():
    random.seed(8)
    parts = ["password", "Token", "APIKEY", "api_key", "ſecret", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "é", "K", "x"]
    least = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        want = [(k, *m.span()) for k, p in _SECRETS.items() for m in re.finditer(p, text, re.A) if least[k](m)]
        assert secret_scan.base_spans(text) == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secret_network(spark, odd):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    key = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"{word()} token = \"{key()}\" {word()} order {random.randrange(10**13, 10**14)} {word()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    net = secret_scan.train(docs)
    got = secret_scan.scan(docs, net).collect()
    assert all([s["kind"] for s in r["spans"]][:2] == ["assign", "hex"] for r in got)
    assert sum(s["kind"] == "model" for r in got for s in r["spans"]) < 15
    hidden = secret_scan.redact(docs, net).collect()
    assert all("token" not in r["text"] and "[SECRET]" in r["text"] for r in hidden)
    assert secret_scan.train(odd) is None
    found = secret_scan.scan(odd, None)
    assert found.count() == odd.count() and found.columns == [*[c for c in odd.columns if c != "spans"], "spans"]
    assert [r["text"] for r in secret_scan.redact(odd, None).collect()] == [r["text"] for r in odd.collect()]


def test_secret_network_finds_what_the_patterns_miss(spark):
    random.seed(10)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(3, 14)))
    key = lambda n: "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"{word()} token = \"{key(random.choice([20, 28, 60]))}\" {word()} {word()} order {random.randrange(10**13, 10**14)} {word()}") for i in range(400)]
    planted = ["QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "kdJwPqRmXzTbLvNcYhGs", key(90)]
    docs = spark.createDataFrame([*rows, *[(1000 + k, f"{word()} {word()} {x} {word()}") for k, x in enumerate(planted)]], "doc_id bigint, text string")
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "model"] for r in secret_scan.scan(docs, secret_scan.train(docs)).collect()}
    assert [got[1000 + k] for k in range(len(planted))] == [[x] for x in planted]
    assert sum(len(got[i]) for i in range(400)) < 20


def test_secret_candidates():
    shown = lambda text: [text[a:b] for a, b in secret_scan.candidates(text)]
    assert shown("see QWxhZGRpbjpvcGVuIHNlc2FtZQ==. and tR7xQ9. the passphrase is sesame, not others") == ["QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "tR7xQ9", "sesame", "others"]
    text = "x" * 50 + " " + "k" * 100 + " behind it"
    seen = secret_scan.windows(text, 51, 151)
    assert seen[-1].endswith(bytes([ord("k") | 128]) + b" behind it\0\0") and {len(w) for w in seen} == {secret_scan.WINDOW} and b"x" * 20 in seen[0]


# --- 8 -----------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op8_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.join(labels, "doc_id").filter("held_out")
    right, total, false = held.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0))).first()
    assert right / total > 0.94 and false <= 2
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.select("doc_id", "held_out").collect())


def test_toxicity_pairs_and_cases(spark, odd):
    """An insult alone and a group alone are clean; only both are toxic: linear weights can't say so."""
    random.seed(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = random.random() < 0.5, random.random() < 0.5
        rows.append((i, " ".join(random.sample([*(["gubbins"] if a else []), *(["klingon"] if b else []), *[f"w{random.randrange(30)}" for _ in range(5)]], 5 + a + b))))
        labels.append((i, int(a and b)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, marks)
    got = toxicity.score(docs, machine).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert got.filter("predicted = toxic").count() / got.count() > 0.95
    found = toxicity.score(odd, machine).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.fit(docs, marks.limit(0)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.5}
    assert toxicity.score(odd.limit(0), machine).count() == 0


# --- 9 -----------------------------------------------------------------------


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            owners[g].append(i)
    for a, b in {p for own in owners.values() for p in combinations(sorted(own), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark, documents):
    random.seed(11)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    base = [f"t{random.randrange(500)}" for _ in range(60)]
    for k in range(120):  # a group of near copies, some too far from each other
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(60)] = f"v{random.randrange(8)}"
        rows.append((10_000 + k, " ".join(w)))
    for k in range(40):  # a chain: each drops another word
        rows.append((20_000 + k, " ".join(f"c{j}" for j in range(k, k + 60))))
    rows += [(30_000, None), (30_001, ""), (30_002, "A b"), (30_003, "a B"), (30_004, "\t"), (30_005, "a b c d e"), (30_006, "A b c d E\n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_cases(spark, odd):
    got = jaccard_join.join(odd).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5)]
    assert jaccard_join.join(odd.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_pieces_are_the_tokenizer():
    path, plain = tokenizer()
    encoder = token_file.PieceEncoder(path, 2, keep=500)
    random.seed(1)
    parts = ["a", " ", "  ", "\n", "'s", "é", "１", "!", "<|endoftext|>", "\t", " ", "\u2003", "b c", "\x1c", "日本", "don't", "٣", "_", "\x85", "😀", "\uffff", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(6000)]
    for i in range(0, len(texts), 100):
        ids, lengths = encoder.encode(texts[i : i + 100])
        for own, text in zip(np.split(ids, np.cumsum(lengths)[:-1]), texts[i : i + 100], strict=True):
            assert own.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_token_pieces_of_one_hash_stay_apart(monkeypatch):
    path, plain = tokenizer()
    monkeypatch.setattr(token_file.PieceEncoder, "_hashes", lambda self, raw, places, sizes: (sizes % 3 + 1).astype(np.uint64) << np.uint64(61))
    encoder = token_file.PieceEncoder(path, 2)
    texts = ["one two six\nten", "", "two one", "été one two", "six ten"]
    for _ in range(2):
        ids, lengths = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 37, n).astype(np.uint32) * 1000
    shard = token_file.Shard(token_file.Shard.pack(ids, np.array([n]), np.array([1])))
    assert (shard.ids() == ids).all()
    for token in {*ids.tolist(), 5}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.find(token, len(places)) == -1
        assert all(shard.find(token, k) == places[k] for k in range(min(4, len(places))))
    for i in range(0, n, 61):
        assert shard.token(i) == ids[i] and shard.count(int(ids[i]), i) == (ids[:i] == ids[i]).sum()


def test_token_files(spark, documents, odd):
    path, plain = tokenizer()
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.unionByName(odd.filter("doc_id is not null").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"), allowMissingColumns=True).collect())
    docs = spark.createDataFrame([*rows, (None, "no place")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in token_file.round_trip(docs, path, tokens_per_shard=4000).collect())
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert token_file.round_trip(docs.limit(0), path).count() == 0
