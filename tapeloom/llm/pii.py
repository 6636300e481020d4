"""Personal data: pattern spans, and gradient-boosted trees over further candidates.

Base spans are leftmost non-overlapping matches per kind that pass a check of their kind: e-mail
addresses, IPv4 addresses, payment card numbers (Luhn), international telephone numbers. They always
stay. High-recall generators propose more candidates, which may overlap: any run around ``@``,
obfuscated addresses, and runs of digits with separators. Boosted trees (Spark ML) see the format of
a candidate and the characters around it. They are to find what the patterns miss, so they are
trained on the base spans of all documents in disguise, without what the patterns go by:
addresses also with ``[at]`` or ``(at)``, telephone numbers without ``+``. Against them stand the candidates
that touch no base span, without look-alikes of a disguised span (these may be what is looked for).
Rows of the same features are one row with their number as its weight. The threshold is calibrated on a fifth of these rows
that is kept from training, so that ``recall`` of its disguised spans stay at or above it. Candidates at or above it that touch no base span are
added; of those that overlap, the one of the highest score.

Everything on the way from texts to spans is DataFrame functions. The place of the i-th match of
a pattern follows from the lengths of the matches and of the gaps that a split by the same
pattern leaves; they are summed up in runs, so that a text of very many matches takes no
square of their number. Each pattern is behind a cheap test of the text.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start: bigint, stop: bigint, text: string>"
_NONE = f"array<{SPAN}>"

# A run of address characters is matched from its start, or from where the last match ended. Where
# giving back characters can't lead to a match, repetition is possessive: it runs in a loop then.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# High recall: what follows is proposed, not decided.
_WIDE_EMAIL = r"[^\s@]++@[^\s@]++|[A-Za-z0-9._-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9.-]++"
_WIDE_DIGITS = r"[(+]?[0-9][0-9().\x20/-]{5,}[0-9]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """All matches in order, with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda p: F.struct(F.length(p["gap"]).cast("bigint").alias("gap"), p["hit"].alias("hit")))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        stop = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), stop.alias("stop"), p["hit"].alias("text"))
        return F.struct(stop.alias("at"), F.when(p["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    width = lambda p: p["gap"] + F.coalesce(F.length(p["hit"]), F.lit(0))
    none = F.array().cast(_NONE)

    def in_runs(every: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(every)))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / size).cast("int")), lambda k: F.slice(every, k * size + 1, size))

        def placed(runs: Column) -> Column:
            widths = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda acc, p: acc + width(p)))
            starts = F.aggregate(widths, F.array(F.lit(0).cast("bigint")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
            spans = F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]))
            return F.flatten(spans)

        return _let(runs, placed)

    return _let(lengths, in_runs)


def _spans(text: Column, gate: Column, pattern: str, keep) -> Column:
    found = F.filter(_matches(text, pattern), keep)
    return F.when(gate, found).otherwise(F.array().cast(_NONE))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_columns(text: Column) -> dict[str, Column]:
    """Base spans of each kind."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return {
        "email": _spans(text, F.contains(text, F.lit("@")), _EMAIL, lambda s: F.lit(True)),
        "ip": _spans(text, text.rlike(r"[0-9]\.[0-9]"), _IP, lambda s: F.forall(F.split(s["text"], r"\."), small)),
        "card": _spans(text, text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), _CARD, lambda s: F.length(_digits(s["text"])).between(16, 19) & F.call_function("luhn_check", _digits(s["text"]))),
        "phone": _spans(text, F.contains(text, F.lit("+")), _PHONE, lambda s: F.length(_digits(s["text"])).between(8, 15)),
    }


def _candidate_column(text: Column) -> Column:
    mail = _spans(text, F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[]at[)\]]"), _WIDE_EMAIL, lambda s: F.length(s["text"]) > 4)
    digits = _spans(text, text.rlike(r"[0-9][0-9().\x20/-]{5}"), _WIDE_DIGITS, lambda s: F.length(_digits(s["text"])) > 6)
    return F.concat(mail, digits)


FEATURES = ("length", "digits", "letters", "dots", "spaces", "dashes", "brackets", "plus", "at", "groups", "longest", "shortest", "first", "before_word", "before_space", "after_space", "cue", "octets", "luhn")

_CUE = r"(?i)(mail|phone|tel|call|fax|card|visa|ip|addr|host|contact)"


def _count(x: Column, char: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(char), F.lit("")))


def features(candidates: DataFrame) -> DataFrame:
    """Format and context features of candidates ``span, left, right``."""
    x, left, right = F.col("span.text"), F.col("left"), F.col("right")
    groups = F.filter(F.split(x, "[^0-9]+"), lambda g: g != "")
    lengths = F.transform(groups, lambda g: F.length(g))
    d = _digits(x)
    made = {
        "length": F.length(x),
        "digits": F.length(d),
        "letters": F.length(F.regexp_replace(x, "[^A-Za-z]", "")),
        "dots": _count(x, "."),
        "spaces": _count(x, " "),
        "dashes": _count(x, "-"),
        "brackets": _count(x, "(") + _count(x, ")") + _count(x, "[") + _count(x, "]"),
        "plus": _count(x, "+"),
        "at": _count(x, "@"),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest": F.coalesce(F.array_min(lengths), F.lit(0)),
        "first": F.coalesce(F.try_element_at(groups, F.lit(1)).substr(1, 1).cast("int"), F.lit(-1)),
        "before_word": left.rlike(r"[A-Za-z0-9_@+.=/-]$").cast("int"),
        "before_space": left.rlike(r"(^|\s)$").cast("int"),
        "after_space": right.rlike(r"^(\s|$)").cast("int"),
        "cue": left.rlike(_CUE).cast("int"),
        "octets": (F.size(groups) == 4) & F.forall(groups, lambda g: (F.length(g) < 4) & (F.lpad(g, 3, "0") <= "255")),
        "luhn": F.length(d).between(16, 19) & F.call_function("luhn_check", d),
    }
    return candidates.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in made.items()])


def _around(span: Column) -> Column:
    """A span with what stands around it in the column ``text``."""
    text = F.col("text")
    left = F.substring(text, F.greatest(F.lit(1), span["start"] - 23).cast("int"), F.least(F.lit(24), span["start"]).cast("int"))
    return F.struct(span.alias("span"), left.alias("left"), F.substring(text, (span["stop"] + 1).cast("int"), F.lit(8)).alias("right"))


def _prepared(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, key``, base spans of each kind, ``proposed``: candidates with what stands around them, and columns ``more``."""
    text = F.col("text")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The key tells rows of one doc_id apart by their texts.
    key = F.struct("doc_id", F.xxhash64("text").alias("of")).alias("key")
    return rows.select("doc_id", key, *[c.alias(k) for k, c in base_columns(text).items()], F.transform(_candidate_column(text), _around).alias("proposed"), *more)


def _spread(prepared: DataFrame) -> DataFrame:
    """One row per candidate: ``key, base, span, left, right``; ``base`` has all base spans of the document."""
    return prepared.select("key", F.concat(*KINDS).alias("base"), F.inline("proposed"))


def _free() -> Column:
    """Whether a candidate touches no base span."""
    return ~F.exists("base", lambda b: (b["start"] < F.col("span.stop")) & (F.col("span.start") < b["stop"]))


def _disguised() -> Column:
    """``kind, seen`` (span, left, right) of base spans: addresses also with the sign spelt out, telephone numbers without ``+``."""

    def shown(kind: str) -> Column:
        def forms(span: Column) -> Column:
            x = span["text"]
            made = {"email": [x, F.replace(x, F.lit("@"), F.lit(" [at] ")), F.replace(x, F.lit("@"), F.lit("(at)"))], "phone": [F.replace(x, F.lit("+"), F.lit(""))]}.get(kind, [x])
            return F.array(*[F.struct(F.lit(kind).alias("kind"), _around(F.struct(span["start"].alias("start"), span["stop"].alias("stop"), form.alias("text"))).alias("seen")) for form in made])

        return F.flatten(F.transform(kind, forms))

    return F.concat(*[shown(k) for k in KINDS])


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    """Features of ``span, left, right``, ``kept`` and columns ``more``, each different row once, with its number as ``weight``."""
    kept = F.pmod(F.xxhash64("span.text", "left", "right"), F.lit(5)) == 0
    made = features(rows).select(kept.alias("kept"), *FEATURES, *more)
    return made.groupBy(*made.columns).agg(F.count("*").cast("double").alias("weight"))


def training_rows(documents: DataFrame) -> DataFrame:
    """``label``, features, ``weight`` and ``kept`` (a fifth, for calibration): 1 for disguised base spans, 0 for candidates that neither touch a base span nor look like a disguised one."""
    # Spans and what stands around them are written, not the texts.
    prepared = cut(_prepared(documents, "text").select("key", *KINDS, "proposed", _disguised().alias("shown")))
    shape = F.regexp_replace("span.text", "[0-9]", "0").alias("shape")
    sought = prepared.select(F.inline("shown")).select("kind", "seen.*")
    shapes = sought.filter("kind = 'phone'").select(shape).distinct()
    # Of digits without a sign between them, the shape says little: there only a cue makes a look-alike.
    told = F.col("shape").rlike("[^0]") | (F.col("cue") == 1)
    mail = F.col("span.text").rlike(r"(?i)[(\[]at[)\]]|@.*[^.]\.[^.]")
    others = _counted(_spread(prepared).filter(_free() & ~mail).select("span", "left", "right"), shape)
    others = others.join(shapes.withColumn("known", F.lit(True)), "shape", "left").filter(~(F.coalesce("known", F.lit(False)) & told))
    marked = [df.select(F.lit(label).alias("label"), "kept", *FEATURES, "weight") for df, label in ((_counted(sought), 1.0), (others, 0.0))]
    return marked[0].unionByName(marked[1]).groupBy("label", "kept", *FEATURES).agg(F.sum("weight").alias("weight"))


def train(documents: DataFrame, *, trees: int = 10, depth: int = 3, recall: float = 0.97) -> tuple[PipelineModel, float] | None:
    """(model, threshold) from all documents; None without both labels in either part.

    A feature is cut at up to 255 places. Spark ML takes them from all rows up to 65,536 different ones, and beyond from about as many of
    them; the trees are grown, and the threshold is set, on all.
    """
    rows = cut(training_rows(documents))
    if rows.select("label", "kept").distinct().count() < 4:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    booster = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=256, stepSize=0.3, seed=11)
    model = PipelineModel([assembler, booster.fit(assembler.transform(rows.filter("not kept")))])
    scored = model.transform(rows.filter("kept")).select("label", F.col("weight").cast("bigint").alias("weight"), vector_to_array("probability")[1].alias("p"))
    least = scored.filter("label = 1").agg(F.percentile("p", F.lit(1 - recall), F.col("weight")).alias("p")).first()["p"]
    return model, least


def find(documents: DataFrame, trained: tuple[PipelineModel, float] | None) -> DataFrame:
    """``doc_id, email, ip, card, phone`` (arrays of base spans) and ``added`` (spans from the trees).

    Spans have start, stop (exclusive) in code points and their text. Defined cases: a null or
    empty text has no spans; repeated rows are read each; an empty table gives no rows; other
    columns are ignored.
    """
    found = _prepared(documents)
    if trained is None:
        return found.select("doc_id", *KINDS, F.array().cast(_NONE).alias("added"))
    model, threshold = trained
    found = cut(found)  # spans and candidates only: the texts are read once
    scored = model.transform(features(_spread(found))).withColumn("p", vector_to_array("probability")[1])
    chosen = scored.filter((F.col("p") >= threshold) & _free()).select("key", "span", "p").distinct()
    # Spans that overlap, one after the other, form a run; the best of a run stays.
    by = W.partitionBy("key").orderBy("span.start", "span.stop")
    before = F.max("span.stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = chosen.withColumn("opens", (F.col("span.start") >= F.coalesce(before, F.lit(0))).cast("int")).withColumn("run", F.sum("opens").over(by))
    best = runs.groupBy("key", "run").agg(F.max_by("span", F.struct("p", "span.stop")).alias("span"))
    added = best.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("added"))
    return found.join(added, "key", "left").select("doc_id", *KINDS, F.coalesce("added", F.array().cast(_NONE)).alias("added"))
