"""Comparison of two recordings of the same traffic: findings, comparability, verdicts.

Recordings are tables ``recording, ord, direction, reencoded, frame, paths`` where ``paths`` is an array of
(path, status, payload); a null frame is an envelope that could not be read, which counts as inbound. Rows pair up
by position within (recording, direction), by a full outer join; nothing is collected but the final one-row verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import frame
from tapeloom.operators.derive import event_equal_sql, with_events
from tapeloom.operators.sequence import running

FINDING = ("recording", "direction", "layer", "kind", "position", "path", "side")
#: What each kind of finding means: (fails interop, fails regression); None: it depends on ``worse``.
JUDGEMENT: dict[str, tuple[bool, bool | None]] = {
    "length": (True, True),
    "direction": (True, True),
    "plaintext": (True, True),
    "malformed_envelope": (True, True),
    "unparsable_frame": (True, True),
    "undeclared_direction": (True, True),
    "derivation": (True, True),
    "derivation_outcome": (True, True),
    "frame": (False, True),
    "plaintext_status": (False, True),
    "plaintext_coverage": (False, None),
    "direction_coverage": (False, None),
    "frame_origin": (False, None),
    "provenance": (False, False),
}


def positions(recording: DataFrame) -> DataFrame:
    """``position`` (from 0) within each direction of a recording, and that direction's ``n``."""
    placed = running(recording, ["recording", "direction"], "ord", "position", F.lit(1), current=False)
    sizes = recording.groupBy("recording", "direction").agg(F.count("*").alias("n"))
    return placed.join(sizes, ["recording", "direction"])


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows by position; columns ``l_*`` and ``r_*``, null where a side has no such row."""
    keys = ["recording", "direction", "position"]

    def side(rows: DataFrame, mark: str) -> DataFrame:
        placed = positions(rows)
        return placed.select(*keys, *[F.col(c).alias(f"{mark}_{c}") for c in placed.columns if c not in keys])

    return side(left, "l").join(side(right, "r"), keys, "full")


_NONE = {"path": "string", "side": "string", "only_left": "bigint", "only_right": "bigint"}


def _finding(kind: str, layer: str = "L0", worse: str = "false", **more: str) -> str:
    """SQL text of one finding."""
    parts = ", ".join(f"'{c}', {more.get(c, f'cast(null as {t})')}" for c, t in _NONE.items())
    return f"named_struct('layer', '{layer}', 'kind', '{kind}', {parts}, 'worse', {worse})"


def _each(cases: list[tuple[str, str]]) -> str:
    """SQL text of an array of the findings whose condition holds."""
    return f"array_compact(array({', '.join(f'if({test}, {made}, null)' for test, made in cases)}))"


def _sides(kind: str, left: str, right: str) -> list[tuple[str, str]]:
    return [(left, _finding(kind, side="'left'")), (right, _finding(kind, side="'right'", worse="true"))]


def _envelopes() -> str:
    """SQL text of what two readable envelopes differ in. Entries meet by path, at the first of the other side."""
    at = lambda side, e: f"get(filter({side}_paths, o -> o.path = {e}.path), 0)"
    only = lambda side, other: f"size(filter({side}_paths, e -> e.status = 0 and coalesce({at(other, 'e')}.status, 1) <> 0))"
    told = lambda kind, test: f"transform(filter(l_paths, e -> coalesce({test}, false)), e -> {_finding(kind, path='e.path')})"
    other = at("r", "e")
    counts = {"only_left": f"cast({only('l', 'r')} as bigint)", "only_right": f"cast({only('r', 'l')} as bigint)"}
    whole = _each(
        [
            ("l_frame <> r_frame", _finding("frame")),
            ("l_reencoded <> r_reencoded", _finding("frame_origin", worse="r_reencoded")),
            (f"{only('l', 'r')} + {only('r', 'l')} > 0", _finding("plaintext_coverage", worse=f"{only('l', 'r')} > 0", **counts)),
        ]
    )
    differs = told("plaintext", f"e.status = 0 and {other}.status = 0 and {other}.payload <> e.payload")
    status = told("plaintext_status", f"e.status <> 0 and {other}.status <> 0 and {other}.status <> e.status")
    return f"concat({whole}, {differs}, {status})"


def findings(left: DataFrame, right: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """All divergences: ``recording, direction, layer, kind, position, path, side, only_left, only_right, worse``.

    ``declared`` has a row per recording, ``recording, l_outbound, r_outbound, l_provenance, r_provenance``: whether each
    producer says that it observes the outbound half, and what its derivation was made from. A recording without
    a row, or all without ``declared``, observes both halves. Directions of unequal length give one ``length`` and are not
    compared further; an outbound half that one side cannot see is a matter of coverage. Events are derived from
    the frames, by the same shapes for both directions, and compared by what they mean; equal bytes mean the same.
    ``worse`` says whether the right side lost something, where that matters.
    """
    pairs = aligned(left, right)
    keys = ["recording", "direction", "layer", "kind", "position", *_NONE, "worse"]

    sizes = pairs.groupBy("recording", "direction").agg(F.count("l_ord").alias("l"), F.count("r_ord").alias("r"))
    no = F.lit(None).cast("string")
    if declared is None:
        sizes = sizes.withColumns({"lo": F.lit(True), "ro": F.lit(True)})
        made_from = None
    else:
        said = declared.select("recording", F.col("l_outbound").alias("lo"), F.col("r_outbound").alias("ro"))
        sizes = sizes.join(said, "recording", "left").na.fill(True, ["lo", "ro"])
        made_from = declared.filter("l_provenance <> r_provenance").select("recording", no.alias("direction"), F.expr(f"array({_finding('provenance', 'L1')})").alias("x"))
    out, unseen = "direction = 'outbound'", "not (lo and ro)"
    per_half = _each(
        [
            *_sides("undeclared_direction", f"{out} and not lo and l > 0", f"{out} and not ro and r > 0"),
            (f"{out} and {unseen} and l <> r", _finding("direction_coverage", worse="l > 0", only_left="l", only_right="r")),
            (f"l <> r and not ({out} and {unseen} and (l = 0 or r = 0))", _finding("length", only_left="l", only_right="r")),
        ]
    )
    halves = sizes.select("recording", "direction", F.expr(per_half).alias("x"))
    if made_from is not None:
        halves = halves.unionByName(made_from)
    halves = halves.select("recording", "direction", F.lit(None).cast("bigint").alias("position"), F.inline("x"))

    readable, differ = "l_frame is not null and r_frame is not null", "coalesce(l_frame <> r_frame, false)"
    same = pairs.filter("l_n = r_n").withColumn("l_found", frame.nodes(F.col("l_frame"))).withColumn("r_found", frame.nodes(F.expr(f"if({differ}, r_frame, null)")))
    seen = same.select(
        "recording",
        "direction",
        F.col("position").cast("bigint").alias("position"),
        F.expr(f"if({readable}, {_envelopes()}, {_each(_sides('malformed_envelope', 'l_frame is null', 'r_frame is null'))})").alias("x"),
        F.expr(f"{readable} and l_found.error is not null").alias("l_bad"),
        F.expr(f"{readable} and if({differ}, r_found.error, l_found.error) is not null").alias("r_bad"),
        # Only these have two events that can differ.
        F.expr(f"{differ} and l_found.error is null and r_found.error is null").alias("two"),
        "l_found",
        "r_found",
    )
    seen = seen.withColumns({f"{m}_seen": F.expr(f"if(two, {m}_found, null)") for m in "lr"}).drop("l_found", "r_found")
    for m in "lr":
        seen = with_events(seen, f"{m}_seen").withColumnsRenamed({"event": f"{m}_event", "error": f"{m}_error"}).drop("shape", f"{m}_seen")
    derived = _each(
        [
            *_sides("unparsable_frame", "l_bad", "r_bad"),
            (f"two and l_event is not null and r_event is not null and not {event_equal_sql('l_event', 'r_event')}", _finding("derivation", "L1")),
            ("two and not (l_error <=> r_error)", _finding("derivation_outcome", "L1")),
        ]
    )
    # The outer form, since Spark would ask the plain one's array for its size, and so derive twice.
    rows = seen.select("recording", "direction", "position", F.expr(f"concat(x, {derived})").alias("x")).select("recording", "direction", "position", F.inline_outer("x")).filter("kind is not null")
    return halves.select(*keys).unionByName(rows.select(*keys))


def fails(profile: str) -> Column:
    """Whether a finding fails a profile: interop or regression."""
    out = F.lit(False)
    for kind, (interop, regression) in JUDGEMENT.items():
        verdict = F.lit(interop) if profile == "interop" else F.col("worse") if regression is None else F.lit(regression)
        out = F.when(F.col("kind") == kind, verdict).otherwise(out)
    return out


def improves() -> Column:
    """Under regression only: plaintexts gained and none lost, or an origin that did not get worse."""
    return F.col("kind").isin("plaintext_coverage", "frame_origin") & ~F.col("worse")


def verdict(found: DataFrame, profile: str) -> DataFrame:
    """One row over all recordings, taken as comparable: ``profile, n_findings, n_failures, verdict``."""
    counts = found.agg(F.count("*").alias("n_findings"), F.count_if(fails(profile)).alias("n_failures"))
    return counts.select(F.lit(profile).alias("profile"), "n_findings", "n_failures", F.when(F.col("n_failures") > 0, "fail").otherwise("pass").alias("verdict"))


def verdicts(found: DataFrame, profile: str, reasons: DataFrame) -> DataFrame:
    """A row per recording: ``recording, n_findings, n_failures, reason, verdict`` (pass, fail or incomparable).

    ``reasons`` has ``recording, reason``: a row per recording that was compared, with why it may not be, or null.
    A reason comes before all findings; they are counted all the same.
    """
    counts = found.groupBy("recording").agg(F.count("*").alias("n_findings"), F.count_if(fails(profile)).alias("n_failures"))
    told = reasons.select("recording", "reason").join(counts, "recording", "left").na.fill(0, ["n_findings", "n_failures"])
    return told.withColumn("verdict", F.when(F.col("reason").isNotNull(), "incomparable").when(F.col("n_failures") > 0, "fail").otherwise("pass"))


def incomparable(a: str, b: str) -> Column:
    """The first reason why two recordings can't be compared, or null; ``a`` and ``b`` are prefixes of ``declared,
    input_digest, unknown_critical, skipped, whole, artifact_class, transform, dictionary``. Where neither side declares
    anything the caller answers for both."""
    l, r = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))  # noqa: E741
    return (
        F.when(~l("declared") & ~r("declared"), F.lit(None))
        .when(~l("declared") | ~r("declared"), "undeclared_input")
        .when((l("unknown_critical") > 0) | (r("unknown_critical") > 0), "unknown_critical_tag")
        .when((l("skipped") > 0) | (r("skipped") > 0), "skipped_record")
        .when(~l("whole") | ~r("whole"), "not_whole")
        .when(l("input_digest").isNull() | r("input_digest").isNull(), "undeclared_input")
        .when(l("input_digest") != r("input_digest"), "different_input")
        .when(l("artifact_class").isNull() | r("artifact_class").isNull(), "undeclared_artifact_class")
        .when(l("artifact_class") != r("artifact_class"), "different_artifact_class")
        .when((l("artifact_class") == "sanitized") & (l("transform").isNull() | ~l("transform").eqNullSafe(r("transform"))), "different_transform")
        .when(~l("dictionary").eqNullSafe(r("dictionary")), "different_dictionary")
    )


def top_findings(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first findings in a total order, with ``remaining``: how many more there are. 0: all."""
    kept = found.orderBy(*[F.col(c) for c in FINDING])
    kept = kept.limit(limit) if limit else kept
    total = found.agg(F.count("*").alias("total"))
    return kept.crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - (limit or F.col("total")))).drop("total")


def table_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: ``keys, field, left, right, change`` for values that differ, as text."""
    fields = [c for c in left.columns if c not in keys]

    def long(rows: DataFrame, name: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
        return rows.select(*keys, cells.alias("c")).select(*keys, "c.field", F.col("c.value").alias(name), F.lit(True).alias(f"in_{name}"))

    both = long(left, "left").join(long(right, "right"), [*keys, "field"], "full").filter(~F.col("left").eqNullSafe(F.col("right")) | F.col("in_left").isNull() | F.col("in_right").isNull())
    change = F.when(F.col("in_left").isNull(), "added").when(F.col("in_right").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "field", "left", "right", change.alias("change"))
