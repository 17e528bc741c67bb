"""Label documents, their rules, timelines and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from .ordered import Scan, block_scan, number_rows, spread_join

REQUIRED = ["taxonomy_version", "date", "participant", "device", "csv_file", "annotation_scope", "recording_duration_s", "window_trainable",
            "annotation_quality", "evidence_tier"]
HARD_SUFFIXES = ["sha256_mismatch", "timestamp_not_strictly_increasing", "sample_rate_outside_5_percent", "non_finite_sensor_value"]


def _in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def label_errors(activity_ids: list[str] | None = None) -> Column:
    """All rule violations of a label document row, in rule order.

    The row has the REQUIRED columns, schema_version and ``segments`` (array of structs). Without
    ``activity_ids`` the strict rule set applies, which does not check activity and motion names.
    The document is one row, so folding over its array needs no shuffle.
    """
    c = F.col
    yes = lambda t: F.coalesce(t, F.lit(False))
    missing = F.array_compact(F.array(*[F.when(c(r).isNull(), r) for r in sorted(REQUIRED)]))
    duration, scope = F.coalesce(c("recording_duration_s"), F.lit(-1.0)), c("annotation_scope")
    weak = yes(scope == "session_weak")
    segments = c("segments")
    head = [F.when(~yes(c("schema_version") == "2.0"), "schema_version must be 2.0"),
            F.when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.concat_ws(",", missing))),
            F.when(~_in(c("evidence_tier"), T.TIERS), "evidence_tier is invalid"),
            F.when((duration > T.SHORT_RECORDING_MAX_S) & ~weak, "recordings over 180 seconds must use session_weak"),
            F.when(weak & (F.size(segments) > 0), "session_weak must not contain supervised segments"),
            F.when(weak & ~yes(c("window_trainable") == False), "session_weak must set window_trainable=false")]  # noqa: E712
    ends = F.aggregate(segments, F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.coalesce(s["end_s"], F.lit(-1.0))))))
    gold = yes(c("evidence_tier") == "gold")

    def rules(s: Column, i: Column) -> Column:
        start, end, wear, motion = F.coalesce(s["start_s"], F.lit(-1.0)), F.coalesce(s["end_s"], F.lit(-1.0)), s["wear_state"], s["motion_state"]
        at = F.concat(F.lit("segments["), i.cast("string"), F.lit("]"))
        bad_wear, use = ~yes(wear == "valid"), yes(s["window_trainable"])
        tests = [(start < F.get(ends, i), " overlaps or is out of order"),
                 ((start < 0) | (end <= start) | ((duration >= 0) & (end > duration + 1e-3)), " has invalid bounds")]
        if activity_ids is not None:
            tests += [(~_in(s["activity_id"], activity_ids), ".activity_id is unknown"), (motion.isNotNull() & ~_in(motion, T.MOTION_STATES), ".motion_state is invalid")]
        tests += [(~_in(wear, T.WEAR_STATES), ".wear_state is invalid"), (bad_wear & use, " invalid wear cannot be window_trainable"),
                  (bad_wear & motion.isNotNull(), " invalid wear must set motion_state=null"), (~_in(s["phase"], T.PHASES), ".phase is invalid"),
                  (gold & use & ~_in(s["label_source"], T.GOLD_SOURCES), " gold label source is not accepted"),
                  (gold & use & ~_in(s["confidence"], ["high", "medium"]), " gold label confidence is too low")]
        return F.array_compact(F.array(*[F.when(t, F.concat(at, F.lit(m))) for t, m in tests]))

    return F.concat(F.array_compact(F.array(*head)), F.flatten(F.transform(segments, rules)))


def migrate_tier(scope: Column, segments: Column) -> Column:
    """Evidence tier from the scope and the sources of trainable segments."""
    sources = F.transform(F.filter(segments, lambda s: F.coalesce(s["window_trainable"], F.lit(False))), lambda s: F.coalesce(s["label_source"], F.lit("")))
    foreign = F.array_except(sources, F.array(*[F.lit(g) for g in T.GOLD_SOURCES]))
    return F.when(scope == "session_weak", "session_weak").when(
        scope == "full_recording", F.when((F.size(sources) > 0) & (F.size(foreign) == 0), "gold").otherwise("legacy_reviewed")).otherwise("rejected")


def label_review(df: DataFrame, name: str, reviewed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Label row of a reviewed raw name. ``reviewed`` has raw_name, activity_id, motion; ``excluded`` adds reason, bad_wear."""
    c = F.col
    d = df.join(reviewed.select(c("raw_name").alias(name), c("activity_id").alias("_a"), c("motion").alias("_m")), name, "left")
    d = d.join(excluded.select(c("raw_name").alias(name), c("activity_id").alias("_xa"), c("motion").alias("_xm"), c("reason").alias("_r"), c("bad_wear").alias("_w")), name, "left")
    out, known = c("_xa").isNotNull(), c("_a").isNotNull()
    wear = F.when(out, F.when(c("_w"), "invalid").otherwise("valid")).when(known, F.when(c("_a") == "removed_wear", "removed").when(c("_a") == "asymmetric_wear", "asymmetric").otherwise("valid"))
    motion = F.when(wear == "valid", F.when(out, c("_xm")).otherwise(c("_m")))
    phase = F.when(out, F.when(c("_w"), "artifact").otherwise("transition")).when(known, F.when(wear != "valid", "artifact").when(c("_m") == "motion", "active").otherwise("rest"))
    return d.withColumns({"activity_id": F.when(out, c("_xa")).otherwise(c("_a")), "wear_state": wear, "motion_state": motion, "phase": phase,
                          "window_trainable": F.when(out, False).when(known, wear == "valid"), "review_note": c("_r")}).drop("_a", "_m", "_xa", "_xm", "_r", "_w")


def convert_legacy(df: DataFrame) -> DataFrame:
    """Legacy documents to v2: over 180 s weak, unreviewed rejected, else one full-recording segment.

    Needs duration_s and the columns of ``label_review``.
    """
    c = F.col
    weak, known = c("duration_s") > T.SHORT_RECORDING_MAX_S, c("wear_state").isNotNull()
    segment = F.array(F.struct(F.lit(0.0).alias("start_s"), c("duration_s").alias("end_s"), "activity_id", "motion_state", "wear_state", "phase", "window_trainable",
                               F.lit("reviewed_exact_action_compatibility").alias("label_source"), F.lit("high").alias("confidence")))
    return df.withColumns({
        "schema_version": F.lit("2.0"),
        "evidence_tier": F.when(weak, "session_weak").when(~known, "rejected").otherwise("legacy_reviewed"),
        "annotation_scope": F.when(weak, "session_weak").when(~known, "review_required").otherwise("full_recording"),
        "doc_trainable": F.when(weak | ~known, False).otherwise(c("window_trainable")),
        "segments": F.when(weak | ~known, F.slice(segment, 1, 0)).otherwise(segment),
        "compatibility_source": F.when(weak | known, "legacy").otherwise("legacy_unreviewed")})


def keep_existing(scanned: DataFrame, existing: DataFrame, id_: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Built labels, but a stored v2 document stays as it is unless ``overwrite``."""
    e = existing.select(id_, F.lit(True).alias("_have"), *[F.col(c).alias(f"_e_{c}") for c in columns])
    j = scanned.join(e, id_, "left")
    have = F.coalesce(F.col("_have"), F.lit(False)) & F.lit(not overwrite)
    return j.withColumns({**{c: F.when(have, F.col(f"_e_{c}")).otherwise(F.col(c)) for c in columns}, "preserved": have}).drop("_have", *[f"_e_{c}" for c in columns])


def first_seen(df: DataFrame, key: list[str], value: str, position: str) -> DataFrame:
    """Distinct non-null values per key at their first position."""
    return df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(position).alias(position))


def weak_targets(participant: DataFrame, by_name: DataFrame, legacy: DataFrame, key: list[str]) -> DataFrame:
    """Ordered target activities by precedence: reviewed participant, raw name, first-seen legacy terms.

    Inputs have key, position, activity_id, sets; output adds total_sets per key.
    """
    ranked = None
    for p, d in enumerate((participant, by_name, legacy)):
        part = d.select(*key, "position", "activity_id", "sets", F.lit(p).alias("_p"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(*key).agg(F.min("_p").alias("_best"))
    chosen = spread_join(ranked, best, key).filter("_p = _best").drop("_p", "_best")
    totals = chosen.groupBy(*key).agg(F.sum("sets").alias("_t")).withColumn("total_sets", F.when(F.col("_t") > 0, F.col("_t"))).drop("_t")
    return spread_join(chosen, totals, key)


def set_violations(docs: DataFrame, id_: str, accepted: str | None = None) -> DataFrame:
    """One row (id, rule) per violated data-set rule; docs carry ``errors`` and ``raw_action``.

    With ``accepted`` a document without violations gives one row of that name.
    """
    c = F.col
    use = lambda s: F.coalesce(s["window_trainable"], F.lit(False))
    some = lambda t: F.exists("segments", t)
    long_ = c("recording_duration_s") > T.SHORT_RECORDING_MAX_S
    dual = lambda s: use(s) & (s["activity_id"].isNull() | ~_in(s["motion_state"], T.MOTION_STATES))
    tests = [(F.size("errors") > 0, "schema"), (long_ & some(use), "long_has_training_windows"),
             (some(lambda s: use(s) & ~F.coalesce(s["wear_state"] == "valid", F.lit(False))), "wear_artifact_trainable"),
             ((c("raw_action") == "跑步机走路") & some(lambda s: s["activity_id"] == "run"), "treadmill_walk_is_run"),
             (c("raw_action").startswith("爬坡") & some(lambda s: use(s) & ~F.coalesce(s["motion_state"] == "motion", F.lit(False))), "incline_not_motion"),
             (long_ & (c("raw_action").contains("3组") | c("raw_action").contains("6组")) & (F.size("segments") > 0), "long_group_record_segmented"),
             (some(dual), "trainable_missing_dual_label")]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for t, n in tests]))
    d = docs.select(id_, hits.alias("_hits"))
    rules = F.col("_hits") if accepted is None else F.when(F.size("_hits") == 0, F.array(F.lit(accepted))).otherwise(F.col("_hits"))
    return d.select(id_, F.explode(rules).alias("rule"))


def label_policy(df: DataFrame, source: str, motion: str | None, activity: str, state: str) -> DataFrame:
    """State from motion_state if present, else from the name's prefix; ``source`` picks taxonomy or input."""
    if source not in ("taxonomy", "input"):
        raise ValueError(f"unknown label source {source}")
    tax = (F.coalesce(F.when(F.col(motion) == "motion", "exercise").when(F.col(motion) == "non_motion", "non_exercise"), F.lit("unlabelled"))
           if motion else T.state_by_prefix(F.col(activity)))
    d = df.withColumns({"input_state": F.coalesce(F.col(state), F.lit("unlabelled")), "taxonomy_state": tax})
    return d.withColumns({"state": F.col("taxonomy_state" if source == "taxonomy" else "input_state"), "label_changed": F.col("input_state") != F.col("taxonomy_state")})


def label_audit(df: DataFrame, activity: str, group: str) -> DataFrame:
    by = [activity, "input_state", "taxonomy_state"]
    return df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.sum("_n").alias("windows"), F.count(group).alias("capture_sessions"))


def trial_audit(streams: DataFrame, labels: DataFrame, pairs: DataFrame, trial: str, device: str) -> DataFrame:
    """Status of each trial from stream reports, label errors and the stream pair.

    A trial has as many streams as its recording set-up (two); its issue list is small.
    """
    c = F.col
    s = streams.groupBy(trial).agg(
        F.sort_array(F.flatten(F.collect_list(F.transform("issues", lambda i: F.concat(c(device).cast("string"), F.lit(":"), i))))).alias("_stream_issues"),
        F.max("clipped_ratio").alias("_clip"))
    j = pairs.join(s, trial, "left").join(labels.select(trial, "errors", "evidence_tier"), trial, "left")
    errors = F.coalesce("errors", F.array(F.lit("label file missing")))
    pair = F.array_compact(F.array(F.when(c("streams") != 2, "dual_ear_stream_missing"), F.when(~c("pair_complete"), "left_right_pair_incomplete"),
                                   F.when(c("note"), "left_right_sync_offset")))
    stream = F.coalesce("_stream_issues", F.array().cast("array<string>"))
    fatal = F.exists(stream, lambda i: F.regexp_like(i, F.lit("(" + "|".join(HARD_SUFFIXES) + ")$")))
    hard = (F.size(errors) > 0) | c("hard") | fatal | F.coalesce(c("_clip") > 0.02, F.lit(False))
    issues = F.concat(errors, pair, stream)
    status = F.when(hard, "recollect_required").when(F.size(issues) > 0, "accepted_with_note").otherwise("accepted")
    return j.select(trial, issues.alias("issues"), status.alias("status"), F.when(hard, "rejected").otherwise(F.coalesce("evidence_tier", F.lit("rejected"))).alias("evidence_tier"))


def session_audit(trials: DataFrame, manifest: DataFrame, session: str, trial: str) -> DataFrame:
    """Acceptance of each session over its manifest's trials; counts, no lists."""
    m = manifest.groupBy(session, trial).agg(F.count(F.lit(1)).alias("_n"))
    j = m.join(trials, trial, "left")
    one = lambda t: F.sum(F.when(F.coalesce(t, F.lit(False)), 1).otherwise(0))
    missing = F.exists("issues", lambda i: i == "label file missing") | F.col("status").isNull()
    g = j.groupBy(session).agg(F.count(F.lit(1)).alias("trials"), one(missing).alias("missing_labels"), one(F.col("_n") > 1).alias("duplicate_trials"),
                               one((F.col("status") == "recollect_required") & ~missing).alias("recollect"))
    total = F.col("missing_labels") + F.col("duplicate_trials") + F.col("recollect")
    return g.withColumns({"violation_count": total, "accepted": total == 0})


# --- timelines -------------------------------------------------------------------------------


def timeline_gap_fill(segments: DataFrame, recordings: DataFrame, key: list[str], order: str, label: str, block: float, filler: str = "unlabelled") -> DataFrame:
    """Cover each recording: clip, trim overlaps by the running end, fill gaps and the tail.

    ``segments`` has start, end; ``recordings`` has rec_start, rec_end.
    """
    c = F.col
    s = spread_join(segments.select(*key, order, label, "start", "end"), recordings, key, "inner")
    s = s.withColumns({"start": F.greatest("start", "rec_start"), "end": F.least("end", "rec_end")}).filter("start < end")
    s = block_scan(s, key, ["start", order], F.floor(c("start") / block), [Scan("_cur", c("end"), "max", inclusive=False)])
    s = s.withColumn("_cur", F.coalesce(F.greatest("_cur", "rec_start"), c("rec_start")))
    own = F.struct(F.greatest("start", "_cur").alias("start"), c("end").alias("end"), c(label).alias(label), F.lit(False).alias("filler"))
    gap = F.struct(c("_cur").alias("start"), c("start").alias("end"), F.lit(filler).alias(label), F.lit(True).alias("filler"))
    parts = s.select(*key, F.explode(F.array_compact(F.array(F.when(c("start") > c("_cur"), gap), F.when(F.greatest("start", "_cur") < c("end"), own)))).alias("_x")).select(*key, "_x.*")
    last = s.groupBy(*key).agg(F.max("end").alias("_end"))
    tail = recordings.join(last, key, "left").withColumn("start", F.coalesce("_end", "rec_start")).filter(c("start") < c("rec_end")).select(
        *key, "start", c("rec_end").alias("end"), F.lit(filler).alias(label), F.lit(True).alias("filler"))
    return parts.unionByName(tail)


def durations_timeline(defs: DataFrame, key: list[str], order: str, duration: str, block: Column) -> DataFrame:
    """Start and end of consecutive steps from the recording's start: a running sum of durations."""
    d = block_scan(defs, key, [order], block, [Scan("end", F.col(duration).cast("double"), "sum")])
    return d.withColumn("start", F.col("end") - F.col(duration))


def time_regressions(df: DataFrame, key: list[str], order: list[str], block: Column, seconds: str) -> DataFrame:
    """Count and largest size of backward steps in file order."""
    d = block_scan(df, key, order, block, [Scan("_prev", F.col(seconds), "last", inclusive=False)])
    back = F.greatest(F.col("_prev") - F.col(seconds), F.lit(0.0))
    return d.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"), F.min(seconds).alias("start_s"), F.max(seconds).alias("end_s"),
                               F.sum(F.when(back > 0, 1).otherwise(0)).alias("regression_count"), F.coalesce(F.max(back), F.lit(0.0)).alias("max_regression_seconds"))


def fragment_continuity(fragments: DataFrame, key: list[str], name: str, max_gap: float = 2.0) -> DataFrame:
    """Gap of each fragment to the end of the one before; order is the numeric suffix, then the name."""
    f = fragments.withColumn("_no", F.coalesce(F.regexp_extract(name, r"_(\d+)\.csv$", 1).try_cast("long"), F.lit(0)))
    f = block_scan(f, key, ["_no", name], F.floor(F.col("_no") / 4096), [Scan("_pe", F.col("end"), "last", inclusive=False)])
    gap = F.col("start") - F.col("_pe")
    return f.withColumns({"gap_seconds": F.round(gap, 6), "discontinuous": F.coalesce((gap < -0.1) | (gap > max_gap), F.lit(False))}).drop("_pe", "_no")


def merge_fragments(rows: DataFrame, key: list[str], fragment: str, line: str) -> DataFrame:
    """Rows of all fragments with one running row index per recording."""
    no = F.coalesce(F.regexp_extract(fragment, r"_(\d+)\.csv$", 1).try_cast("long"), F.lit(0))
    d = rows.withColumn("_no", no)
    return number_rows(d, key, ["_no", fragment, line], F.col("_no"), "row_index").drop("_no")
