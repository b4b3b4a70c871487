"""Queries over manifests, lookups, summaries, splits and metrics, with their DuckDB statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIAMETERS, FAULT_MULTIPLIERS, RPM_BY_LOAD
from ..functions import kinematics
from ..functions.statistics import rounded
from ..operators import experiments, layouts, quality, splits, summary
from ..staging import staged
from .standins import MANIFEST, SPEEDS, manifest, r6, recordings, samples, speeds, table

_LOADS = "l AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS load, unnest([1797, 1772, 1750, 1730])::INTEGER AS rpm)"
_RATIO = 0.3126 / 1.537


def _loads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in RPM_BY_LOAD.items()], "load int, rpm int")


# ---- kinematics and lookups --------------------------------------------------


def fault_frequencies(spark, sf_dir):
    """At the speed of every row of the manifest."""
    return speeds(spark, sf_dir).select("k", "load", *(rounded(c).alias(n) for n, c in kinematics.fault_frequencies(F.col("rpm")).items()))


def order_table(spark, sf_dir):
    """Fault frequencies as orders: the same at every speed."""
    found = kinematics.fault_frequencies(F.col("rpm"))
    return speeds(spark, sf_dir).select("k", *(rounded(kinematics.order_of(c, F.col("rpm"))).alias(f"{n}_order") for n, c in found.items() if n != "f_rot"))


def fault_multipliers(spark, sf_dir):
    """Fault frequencies by fixed multipliers for every row's load, with the default speed where it is unknown."""
    return manifest(spark, sf_dir).select("k", *(rounded(c).alias(n) for n, c in kinematics.fault_multiples(kinematics.rpm_of(F.col("load_hp"))).items()))


def harmonics(spark, sf_dir):
    """First three multiples up to 300 Hz of each fault frequency but the rotation's, at the speed of every row of the manifest."""
    found = kinematics.fault_frequencies(F.col("rpm"))

    def named(fault: str, c: F.Column) -> F.Column:
        return F.transform(kinematics.harmonics(c, 300.0), lambda x: F.struct(F.lit(fault).alias("fault"), x["h"].alias("h"), x["hz"].alias("hz")))

    each = [named(k, c) for k, c in found.items() if k != "f_rot"]
    return speeds(spark, sf_dir).select("k", F.inline(F.concat(*each))).select("k", "fault", "h", rounded(F.col("hz")).alias("hz"))


def rpm_lookup_default(spark, sf_dir):
    return manifest(spark, sf_dir).select("k", "load_hp", kinematics.rpm_of(F.col("load_hp")).alias("rpm"))


def rpm_lookup_inner(spark, sf_dir):
    nominal = F.broadcast(_loads(spark))  # four fixed rows
    return manifest(spark, sf_dir).join(nominal, F.col("load_hp") == F.col("load")).select("k", "load", "rpm", rounded(F.col("rpm_from_file") - F.col("rpm")).alias("off"))


# ---- paths -------------------------------------------------------------------


def parse_layout_hp(spark, sf_dir):
    return manifest(spark, sf_dir).select("path_a", *(c.alias(k) for k, c in layouts.by_load_folder("path_a").items()))


def parse_layout_parts(spark, sf_dir):
    return layouts.resolved(manifest(spark, sf_dir), "path_b")


def parse_layout_eda(spark, sf_dir):
    return manifest(spark, sf_dir).select("path_c", *(c.alias(k) for k, c in layouts.by_type_folders("path_c").items()))


def class_label(spark, sf_dir):
    p = parse_layout_eda(spark, sf_dir)
    return p.select("path_c", layouts.class_label(F.col("fault_type"), F.col("fault_size"), F.col("position")).alias("class_label"))


def file_id(spark, sf_dir):
    return manifest(spark, sf_dir).select("k", layouts.file_id(F.col("label"), F.col("load_hp"), F.col("fault_diameter_mils"), F.col("path_a")).alias("file_id"))


# ---- rules -------------------------------------------------------------------


def _checked(spark, sf_dir) -> DataFrame:
    return quality.flagged(manifest(spark, sf_dir))


def dq_flags(spark, sf_dir):
    return _checked(spark, sf_dir).select("k", "warnings", "has_warning")


def dq_messages(spark, sf_dir):
    """The rules' full messages, with the values that broke them."""
    return _checked(spark, sf_dir).select("k", "messages")


def dq_rule_counts(spark, sf_dir):
    return quality.rule_counts(_checked(spark, sf_dir), spark)


def dq_rules_hit(spark, sf_dir):
    """Codes with at least one row, the most frequent first."""
    return quality.rule_counts(_checked(spark, sf_dir), spark).filter("n > 0").orderBy(F.desc("n"), "code")


def dq_keyword_counts(spark, sf_dir):
    return quality.keyword_counts(_checked(spark, sf_dir), quality.CODES)


def dq_warned_rows(spark, sf_dir):
    return _checked(spark, sf_dir).filter("has_warning").select("k", "label", "load_hp", "warnings")


#: Load, label, size, position, samples, rpm and the expected codes.
PLANTED = [
    (1, 0, "Normal", None, None, 480000, 1797.0),
    (2, 0, "OR", 7, "Orthogonal", 120000, 1797.0),
    (3, 0, "B", 28, None, 120000, 1797.0),
    (4, 1, "IR", 14, None, 120000, 1650.0),
    (5, 0, "Normal", None, None, 243938, 1796.0),
    (6, 0, "IR", 7, None, 84000, 1797.0),
    (7, 0, "IR", 7, None, 120000, 1817.0),
    (8, 0, "OR", 7, None, 120000, 1797.0),
    (9, 0, "OR", 7, "centered_x", 120000, 1797.0),
    (10, 0, "IR", 99, None, 120000, 1797.0),
    (11, 0, None, 7, None, 120000, 1797.0),
    (12, None, "IR", 7, None, 120000, 1797.0),
    (13, None, None, 28, None, None, None),
]


def dq_edge_cases(spark, sf_dir):
    """Every row of the manifest with the values of one planted case in place of its own."""
    names = ("load_hp", "label", "fault_diameter_mils", "or_position", "n_samples_DE", "rpm_from_file")
    kinds = ("int", "string", "int", "string", "bigint", "double")
    case = F.col("k") % len(PLANTED)
    value = lambda at, kind: F.get(F.array(*(F.lit(row[at]).cast(kind) for row in PLANTED)), case.cast("int"))
    rows = manifest(spark, sf_dir).select("k", *(value(at + 1, kind).alias(name) for at, (name, kind) in enumerate(zip(names, kinds, strict=True))))
    return quality.flagged(rows).select("k", (case + 1).cast("int").alias("case"), "warnings")


def _flags(source: str) -> str:
    at = lambda fs: f"abs(n_samples_DE / {fs}.0::DOUBLE - 10) <= 3"
    nominal = "CASE load_hp " + " ".join(f"WHEN {k} THEN {v}" for k, v in RPM_BY_LOAD.items()) + " END"
    tests = (
        f"{at(48000)} AND NOT {at(12000)}", f"NOT {at(48000)} AND NOT {at(12000)}", f"abs(rpm_from_file - ({nominal})) > 20", "fault_diameter_mils IN (28, 40)",
        f"fault_diameter_mils NOT IN ({', '.join(map(str, DIAMETERS))})", "label = 'OR' AND or_position IS NULL", "label = 'OR' AND NOT contains(lower(or_position), 'centered')", "label IS NULL", "load_hp IS NULL",
    )
    lasting = "n_samples_DE, n_samples_DE / 12000.0::DOUBLE, n_samples_DE / 48000.0::DOUBLE"
    values = (lasting, lasting, f"rpm_from_file, load_hp, {nominal}", "fault_diameter_mils", "fault_diameter_mils", None, "or_position", None, None)
    codes = ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in zip(quality.CODES, tests, strict=True))
    said = (m.replace("'", "''") for m in quality.MESSAGES)
    texts = ", ".join(f"CASE WHEN {t} THEN " + (f"printf('{c}: {m}', {v})" if v else f"'{c}: {m}'") + " END" for c, m, t, v in zip(quality.CODES, said, tests, values, strict=True))
    kept = lambda x: f"CASE WHEN n_samples_DE IS NULL THEN [] ELSE list_filter([{x}], lambda c: c IS NOT NULL) END"
    return f"q AS (SELECT *, {kept(codes)} AS codes, {kept(texts)} AS texts FROM {source}), w AS (SELECT *, array_to_string(codes, '; ') AS warnings, array_to_string(texts, '; ') AS messages FROM q)"


# ---- summaries ---------------------------------------------------------------


def pivot_label_load(spark, sf_dir):
    return summary.pivot_counts(manifest(spark, sf_dir), "label", "load_hp", [0, 1, 2, 3], "path_a")


def class_counts(spark, sf_dir):
    return summary.counts_by(class_label(spark, sf_dir), "class_label")


def load_counts(spark, sf_dir):
    return summary.counts_by(manifest(spark, sf_dir), "load_hp")


def load_imbalance(spark, sf_dir):
    return summary.imbalance(load_counts(spark, sf_dir)).withColumn("ratio", rounded(F.col("ratio")))


def warn_rate(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_warning").alias("n_warned"), rounded(summary.share(F.col("has_warning"))).alias("percent"))


def distinct_files(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.countDistinct("user_id").alias("files"), F.countDistinct("event_type").alias("types"), F.count(F.lit(1)).alias("n"))


def boxplot_stats(spark, sf_dir):
    rows = summary.boxplot(samples(spark, sf_dir), "event_type", "value")
    return rows.select("event_type", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "q1", "median", "q3", "low", "high")))


def representative_file(spark, sf_dir):
    parts = layouts.by_type_folders("path_c")
    label = layouts.class_label(parts["fault_type"], parts["fault_size"], parts["position"])
    rows = manifest(spark, sf_dir).select(label.alias("class_label"), "load_hp", "k")
    return summary.representatives(rows, "class_label", "load_hp", 0, "k")


def pick_file(spark, sf_dir):
    return summary.pick_file(manifest(spark, sf_dir), "IR", 1, 7, "k").select("k", "path_a")


def topk(spark, sf_dir):
    return summary.top(table(spark, sf_dir, "orders"), "o_totalprice", 30, "o_orderkey").select("o_orderkey", rounded(F.col("o_totalprice")).alias("o_totalprice"))


def order_pivot(spark, sf_dir):
    """Orders by priority and status."""
    return summary.pivot_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_orderkey", "status_")


def percent_table(spark, sf_dir):
    """Share of rows with a warning by load, as text."""
    rows = _checked(spark, sf_dir).filter("load_hp is not null").groupBy("load_hp").agg((F.count_if("has_warning") / F.count(F.lit(1))).alias("share"))
    return rows.select("load_hp", summary.percent_text(F.col("share")).alias("warned"))


def jaccard_pairs(spark, sf_dir):
    """Similarity of the sets of event types by hour of the day."""
    sets = samples(spark, sf_dir).filter("value > 0").select(F.hour("ts").alias("hour"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("m")).groupBy("hour").agg(F.collect_set("m").alias("m"))
    return summary.jaccard_pairs(sets, "hour", "m").select("left", "right", rounded(F.col("jaccard")).alias("jaccard"))


def set_sizes(spark, sf_dir):
    """Users on both sides of the random split of all events, on either, and more often on the test side."""
    rows = split_random(spark, sf_dir)
    a, b = rows.filter("split = 'test'").select("user_id"), rows.filter("split = 'train'").select("user_id")
    named = [("both", a.intersect(b)), ("either", a.union(b).distinct()), ("more_in_test", a.exceptAll(b).distinct())]
    out = [x.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, x in named]
    return out[0].union(out[1]).union(out[2])


# ---- joins and splits --------------------------------------------------------


def _known_users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id"))


def semi_files(spark, sf_dir):
    return recordings(spark, sf_dir).select("user_id").join(_known_users(spark, sf_dir), "user_id", "left_semi")


def anti_files(spark, sf_dir):
    return recordings(spark, sf_dir).select("user_id").join(_known_users(spark, sf_dir), "user_id", "left_anti")


def split_random(spark, sf_dir):
    return splits.random_rows(samples(spark, sf_dir).select("event_id", "user_id"), "event_id")


def split_by_file(spark, sf_dir):
    return splits.by_file(samples(spark, sf_dir).select("event_id", "user_id"), "user_id")


def split_stratified_files(spark, sf_dir):
    files = manifest(spark, sf_dir).filter("label is not null and load_hp is not null").select("k", "label", "load_hp")
    return splits.stratified_files(files, "label", "load_hp", "k")


def split_stratified_rows(spark, sf_dir):
    return splits.stratified_rows(samples(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id")


def lolo_folds(spark, sf_dir):
    """Each load of the manifest left out once."""
    folds = splits.folds(manifest(spark, sf_dir).filter("load_hp is not null").select(F.col("load_hp").alias("load")).distinct())
    return folds.select("test_load", F.array_join("trainval_loads", ",").alias("trainval_loads"))


def lolo_split(spark, sf_dir):
    rows = manifest(spark, sf_dir).filter("load_hp is not null").select("k", "load_hp")
    return splits.leave_one_load_out(rows, "load_hp", 2).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("load_hp").alias("least"), F.max("load_hp").alias("most"))


def leakage_overlap(spark, sf_dir):
    """Recordings on both sides of a random and of a file split."""
    a = splits.leaking_files(split_random(spark, sf_dir), "user_id").agg(F.lit("random").alias("split"), F.count(F.lit(1)).alias("files"))
    b = splits.leaking_files(split_by_file(spark, sf_dir), "user_id").agg(F.lit("file").alias("split"), F.count(F.lit(1)).alias("files"))
    return a.union(b)


# ---- metrics and models ------------------------------------------------------


def accuracy_macro_f1(spark, sf_dir):
    rows = experiments.accuracy_macro_f1(table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null"), "quality", "toxic")
    return rows.select(rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("f1_macro")).alias("f1_macro"), "n")


def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    known = experiments.scaling(rows, ["size", "price"])
    return experiments.scaled(rows, known).select("p_partkey", rounded(F.col("size")).alias("size"), rounded(F.col("price")).alias("price"))


def _labelled(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    from ..operators.feature_tables import FEATURES, full_table
    from .standins import segments

    rows = segments(spark, sf_dir).filter("label is not null").select("vec_id", (F.col("label") % 4).cast("int").alias("Label"), (F.col("vec_id") % 4).cast("int").alias("Load"), (F.col("vec_id") / 5).cast("int").alias("file"), "x")
    return staged(full_table(rows, "x", "Load", tolerance=100.0).na.fill(0.0), "labelled"), FEATURES


def rf_importance(spark, sf_dir):
    df, columns = _labelled(spark, sf_dir)
    return experiments.importances(spark, experiments.forest(df, columns, "Label"), columns, 10)


def rf_split_comparison(spark, sf_dir):
    df, columns = _labelled(spark, sf_dir)
    return experiments.compare_splits(df, columns, "Label", "vec_id", "file")


def mlp_lolo(spark, sf_dir):
    """Four networks, one for each load left out, trained together."""
    df, columns = _labelled(spark, sf_dir)
    scores = experiments.train_and_score_runs(experiments.loads_left_out(df, "A3", columns, "Label", "Load", "vec_id", range(4)), 4)
    return experiments.results_of(scores, F.lit("all"))


def model_split_sizes(spark, sf_dir):
    """Rows on either side of every split that the models are trained on, and those held back to stop a fit."""
    df = table(spark, sf_dir, "embeddings").filter("label is not null").select("vec_id", (F.col("label") % 4).cast("int").alias("Label"), (F.col("vec_id") % 4).cast("int").alias("Load"), (F.col("vec_id") / 5).cast("int").alias("file"), F.lit(0.0).alias("f"))
    lolo = experiments.loads_left_out(df, "A3", ["f"], "Label", "Load", "vec_id", range(4))
    held = splits.stratified_rows(lolo.filter("part = 'train'").withColumn("stratum", F.struct("run", "y")), "stratum", "key", 0.15)
    sides = [("random", splits.random_rows(df, "vec_id")), ("file", splits.by_file(df, "file"))]
    rows = [x.select(F.lit(name).alias("name"), F.col("split").alias("side")) for name, x in sides]
    rows += [lolo.select(F.col("run").alias("name"), F.col("part").alias("side")), held.filter("split = 'test'").select(F.col("run").alias("name"), F.lit("held back").alias("side"))]
    return reduce(DataFrame.unionByName, rows).groupBy("name", "side").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fault_frequencies, order_table, fault_multipliers, harmonics, rpm_lookup_default, rpm_lookup_inner, parse_layout_hp, parse_layout_parts, parse_layout_eda,
        class_label, file_id, dq_flags, dq_messages, dq_rule_counts, dq_rules_hit, dq_keyword_counts, dq_warned_rows, dq_edge_cases, pivot_label_load, class_counts, load_counts,
        load_imbalance, warn_rate, distinct_files, boxplot_stats, representative_file, pick_file, topk, order_pivot, percent_table, jaccard_pairs, set_sizes,
        semi_files, anti_files, split_random, split_by_file, split_stratified_files, split_stratified_rows, lolo_folds, lolo_split, leakage_overlap,
        accuracy_macro_f1, standard_scale, rf_importance, rf_split_comparison, mlp_lolo, model_split_sizes,
    )
}

_F = {
    "f_rot": "rpm / 60.0::DOUBLE", "BPFO": f"rpm / 60.0::DOUBLE * (4.5 * (1 - {_RATIO!r}::DOUBLE))", "BPFI": f"rpm / 60.0::DOUBLE * (4.5 * (1 + {_RATIO!r}::DOUBLE))",
    "BSF": f"rpm / 60.0::DOUBLE * (1.537::DOUBLE / (2 * 0.3126::DOUBLE) * (1 - {_RATIO!r}::DOUBLE * {_RATIO!r}::DOUBLE))", "FTF": f"rpm / 60.0::DOUBLE * ((1 - {_RATIO!r}::DOUBLE) / 2)",
}
_CASE = "CASE load_hp WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 ELSE 1797 END"
_TYPES = r"""c AS (SELECT k, load_hp AS own_load, path_c, string_split(path_c, '/') AS f, contains(path_c, 'Normal') AS n FROM p), d AS (SELECT *, coalesce(starts_with(f[-2], '@'), false) AS placed FROM c),
t AS (SELECT k, own_load, path_c, CASE WHEN n THEN 'Normal' WHEN placed THEN f[-4] ELSE f[-3] END AS fault_type, CASE WHEN n THEN 'None' WHEN placed THEN f[-3] ELSE f[-2] END AS fault_size,
  CASE WHEN n OR NOT placed THEN 'None' ELSE f[-2] END AS position, try_cast(nullif(regexp_extract(f[-1], '_(\d)\.mat$', 1), '') AS INTEGER) AS load_hp FROM d),
cl AS (SELECT *, CASE WHEN fault_type = 'Normal' THEN 'Normal' ELSE concat_ws('_', fault_type, fault_size, CASE WHEN position <> 'None' THEN position END) END AS class_label FROM t)"""
_FLAGS = f"WITH {MANIFEST}, {_flags('p')}"
_CODES = ", ".join(f"'{c}'" for c in quality.CODES)
_COUNTS = f"n AS (SELECT c.code, count(u.code)::BIGINT AS n FROM (SELECT unnest([{_CODES}]) AS code) c LEFT JOIN (SELECT unnest(codes) AS code FROM w) u ON u.code = c.code GROUP BY c.code)"
_SPLIT = "SELECT event_id, user_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || event_id), event_id) <= floor(count(*) OVER () * 0.3) THEN 'test' ELSE 'train' END AS split FROM events"
_BY_FILE = "SELECT event_id, user_id, split FROM events JOIN (SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || user_id), user_id) <= greatest(floor(count(*) OVER () * 0.3), 1) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT user_id FROM events)) USING (user_id)"
_LEAK = "SELECT '{0}' AS split, count(*)::BIGINT AS files FROM (SELECT user_id FROM ({1}) GROUP BY user_id HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'test') > 0)"
_USERS = "SELECT o_custkey FROM orders WHERE o_totalprice > 400000"
_PLANTED = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in PLANTED)
_RUNS = "l AS (SELECT vec_id, label % 4 AS y, 'A3|load ' || k || ' left out' AS name, CASE WHEN vec_id % 4 = k THEN 'test' ELSE 'train' END AS side FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE label IS NOT NULL)"
_SIZES = f"""WITH e AS (SELECT vec_id, vec_id // 5 AS f FROM embeddings WHERE label IS NOT NULL), {_RUNS},
a AS (SELECT CASE WHEN row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) <= floor(count(*) OVER () * 0.3) THEN 'test' ELSE 'train' END AS side FROM e),
g AS (SELECT f, CASE WHEN row_number() OVER (ORDER BY md5('42|' || f), f) <= greatest(floor(count(*) OVER () * 0.3), 1) THEN 'test' ELSE 'train' END AS side FROM (SELECT DISTINCT f FROM e)),
h AS (SELECT name, row_number() OVER w <= round(count(*) OVER (PARTITION BY name, y) * 0.15::DOUBLE) AS held FROM l WHERE side = 'train' WINDOW w AS (PARTITION BY name, y ORDER BY md5('42|' || vec_id), vec_id))
SELECT name, side, count(*)::BIGINT AS n FROM (SELECT 'random' AS name, side FROM a UNION ALL SELECT 'file', side FROM e JOIN g USING (f) UNION ALL SELECT name, side FROM l UNION ALL SELECT name, 'held back' FROM h WHERE held) GROUP BY ALL"""
ORACLES = {
    "model_split_sizes": _SIZES,
    "fault_frequencies": f"WITH {MANIFEST}, {SPEEDS} SELECT k, load, " + ", ".join(f"{r6(e)} AS {k}" for k, e in _F.items()) + " FROM w",
    "order_table": f"WITH {MANIFEST}, {SPEEDS} SELECT k, " + ", ".join(f"{r6(f'{e} / (rpm / 60.0::DOUBLE)')} AS {k}_order" for k, e in _F.items() if k != "f_rot") + " FROM w",
    "fault_multipliers": f"WITH {MANIFEST} SELECT k, " + ", ".join(f"{r6(f'({_CASE}) / 60.0::DOUBLE * {m}::DOUBLE')} AS {n}" for n, m in FAULT_MULTIPLIERS.items()) + " FROM p",
    "harmonics": f"WITH {MANIFEST}, {SPEEDS}, f AS (" + " UNION ALL ".join(f"SELECT k, '{k}' AS fault, {e} AS hz FROM w" for k, e in _F.items() if k != "f_rot") + f") SELECT k, fault, h::INTEGER AS h, {r6('hz * h')} AS hz FROM f, (SELECT unnest([1, 2, 3]) AS h) WHERE hz * h <= 300",
    "rpm_lookup_default": f"WITH {MANIFEST} SELECT k, load_hp, ({_CASE})::INTEGER AS rpm FROM p",
    "rpm_lookup_inner": f"WITH {MANIFEST}, {_LOADS} SELECT k, load, rpm, {r6('rpm_from_file - rpm')} AS off FROM p JOIN l ON load_hp = load",
    "parse_layout_hp": f"WITH {MANIFEST}, a AS (SELECT path_a, string_split(path_a, '/')[-2] AS folder, regexp_replace(string_split(path_a, '/')[-1], '\\.[^.]*$', '') AS stem FROM p), b AS (SELECT *, starts_with(lower(stem), 'normal') AS n, string_split(stem, '_') AS s FROM a) "
    "SELECT path_a, try_cast(nullif(regexp_extract(folder, '(\\d+)\\s*hp', 1, 'i'), '') AS INTEGER) AS load_hp, CASE WHEN n THEN 'Normal' WHEN upper(s[1]) IN ('IR', 'OR', 'B') THEN upper(s[1]) END AS label, "
    "CASE WHEN NOT n AND regexp_matches(s[2], '^[0-9]+$') THEN try_cast(s[2] AS INTEGER) END AS fault_diameter_mils, CASE WHEN NOT n AND upper(s[1]) = 'OR' THEN s[3] END AS or_position FROM b",
    "parse_layout_parts": f"WITH {MANIFEST}, a AS (SELECT path_b, string_split(upper(path_b), '/') AS s, string_split(path_b, '/')[-1] AS f FROM p), "
    "b AS (SELECT path_b, f, CASE WHEN list_contains(s, 'NORMAL') THEN 0 WHEN list_contains(s, 'IR') THEN 1 WHEN list_contains(s, 'OR') THEN 2 WHEN list_contains(s, 'B') THEN 3 ELSE -1 END AS l FROM a), "
    "c AS (SELECT path_b, l, coalesce(try_cast(nullif(regexp_extract(f, '_(\\d+)\\.mat$', 1), '') AS INTEGER), CASE WHEN l = 0 THEN CASE WHEN contains(f, '97') THEN 0 WHEN contains(f, '98') THEN 1 WHEN contains(f, '99') THEN 2 WHEN contains(f, '100') THEN 3 ELSE -1 END END, -1) AS h FROM b) "
    'SELECT path_b AS "Filepath", l::INTEGER AS "Label", h::INTEGER AS "Load" FROM c WHERE l <> -1 AND h <> -1',
    "parse_layout_eda": f"WITH {MANIFEST}, {_TYPES} SELECT path_c, fault_type, fault_size, position, load_hp FROM t",
    "class_label": f"WITH {MANIFEST}, {_TYPES} SELECT path_c, class_label FROM cl",
    "file_id": f"WITH {MANIFEST} SELECT k, concat_ws('_', coalesce(label, 'nan'), coalesce(load_hp::VARCHAR, 'nan'), coalesce(fault_diameter_mils::VARCHAR, 'nan'), coalesce(path_a, 'nan')) AS file_id FROM p",
    "dq_flags": f"{_FLAGS} SELECT k, warnings, warnings <> '' AS has_warning FROM w",
    "dq_messages": f"{_FLAGS} SELECT k, messages FROM w",
    "dq_rule_counts": f"{_FLAGS}, {_COUNTS} SELECT * FROM n",
    "dq_rules_hit": f"{_FLAGS}, {_COUNTS} SELECT * FROM n WHERE n > 0",
    "dq_keyword_counts": f"{_FLAGS} SELECT " + ", ".join(f"coalesce(sum((length(warnings) - length(replace(warnings, '{c}', ''))) // length('{c}')), 0)::BIGINT AS \"{c}\"" for c in quality.CODES) + " FROM w",
    "dq_warned_rows": f"{_FLAGS} SELECT k, label, load_hp, warnings FROM w WHERE warnings <> ''",
    "dq_edge_cases": f"WITH c AS (SELECT * FROM (VALUES {_PLANTED}) t(kase, load_hp, label, fault_diameter_mils, or_position, n_samples_DE, rpm_from_file)), r AS (SELECT p_partkey AS k, c.* FROM part JOIN c ON kase = p_partkey % {len(PLANTED)} + 1), {_flags('r')} SELECT k, kase::INTEGER AS \"case\", warnings FROM w",
    "pivot_label_load": f"WITH {MANIFEST} SELECT label, " + ", ".join(f"count(CASE WHEN load_hp = {k} THEN path_a END)::BIGINT AS load_{k}" for k in range(4)) + " FROM p WHERE label IS NOT NULL AND load_hp IS NOT NULL GROUP BY label",
    "class_counts": f"WITH {MANIFEST}, {_TYPES} SELECT class_label, count(*)::BIGINT AS n FROM cl WHERE class_label IS NOT NULL GROUP BY class_label",
    "load_counts": f"WITH {MANIFEST} SELECT load_hp, count(*)::BIGINT AS n FROM p WHERE load_hp IS NOT NULL GROUP BY load_hp",
    "load_imbalance": f"WITH {MANIFEST}, n AS (SELECT load_hp, count(*)::BIGINT AS n FROM p WHERE load_hp IS NOT NULL GROUP BY load_hp) SELECT max(n) AS most, min(n) AS least, {r6('max(n)::DOUBLE / min(n)')} AS ratio, max(n)::DOUBLE / min(n) > 1.5 AS imbalanced FROM n",
    "warn_rate": f"{_FLAGS} SELECT count(*)::BIGINT AS n, (count(*) FILTER (warnings <> ''))::BIGINT AS n_warned, {r6('100.0::DOUBLE * count(*) FILTER (warnings <> $$$$) / greatest(count(*), 1)')} AS percent FROM w".replace("$$$$", "''"),
    "distinct_files": "SELECT count(DISTINCT user_id)::BIGINT AS files, count(DISTINCT event_type)::BIGINT AS types, count(*)::BIGINT AS n FROM events",
    "boxplot_stats": "WITH q AS (SELECT event_type, count(*)::BIGINT AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type), "
    "b AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type) "
    "SELECT event_type, n, " + ", ".join(f"{r6(c)} AS {c}" for c in ("mean", "q1", "median", "q3", "low", "high")) + " FROM q JOIN b USING (event_type)",
    "representative_file": f"WITH {MANIFEST}, {_TYPES}, j AS (SELECT cl.class_label, p.load_hp, p.k FROM p JOIN cl ON p.path_c = cl.path_c), r AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY CASE WHEN load_hp = 0 THEN 0 ELSE 1 END, k) AS n FROM j WHERE class_label IS NOT NULL) SELECT class_label, load_hp, k FROM r WHERE n = 1",
    "pick_file": f"WITH {MANIFEST} SELECT k, path_a FROM p WHERE label = 'IR' AND load_hp = 1 AND fault_diameter_mils = 7 ORDER BY k LIMIT 1",
    "topk": f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 30",
    "order_pivot": "SELECT o_orderpriority, " + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN o_orderkey END)::BIGINT AS status_{s}" for s in "FOP") + " FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority",
    "percent_table": f"{_FLAGS} SELECT load_hp, round((count(*) FILTER (warnings <> ''))::DOUBLE / count(*) * 100, 2)::VARCHAR || '%' AS warned FROM w WHERE load_hp IS NOT NULL GROUP BY load_hp",
    "jaccard_pairs": f"WITH s AS (SELECT hour(ts)::INTEGER AS hour, list(DISTINCT event_type || ':' || (user_id % 20)) AS m FROM events WHERE value > 0 GROUP BY ALL) SELECT a.hour AS \"left\", b.hour AS \"right\", {r6('len(list_intersect(a.m, b.m))::DOUBLE / len(list_distinct(list_concat(a.m, b.m)))')} AS jaccard FROM s a JOIN s b ON a.hour < b.hour",
    "set_sizes": f"WITH s AS ({_SPLIT}), a AS (SELECT user_id FROM s WHERE split = 'test'), b AS (SELECT user_id FROM s WHERE split = 'train') SELECT 'both' AS kind, count(*)::BIGINT AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*)::BIGINT FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'more_in_test', count(*)::BIGINT FROM (SELECT DISTINCT user_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))",
    "semi_files": f"SELECT DISTINCT user_id FROM events WHERE user_id IN ({_USERS})",
    "anti_files": f"SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM ({_USERS}) o WHERE o.o_custkey = e.user_id)",
    "split_random": _SPLIT,
    "split_by_file": _BY_FILE,
    "split_stratified_files": f"WITH {MANIFEST}, g AS (SELECT k, label, load_hp, count(*) OVER g AS n, row_number() OVER (PARTITION BY label, load_hp ORDER BY md5('42|' || k), k) AS r FROM p WHERE label IS NOT NULL AND load_hp IS NOT NULL WINDOW g AS (PARTITION BY label, load_hp)), "
    "h AS (SELECT *, greatest(1, round_even(n * 0.7::DOUBLE, 0)) AS a0, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS b0 FROM g), i AS (SELECT *, CASE WHEN a0 + b0 >= n THEN greatest(1, n - 2) ELSE a0 END AS a, CASE WHEN a0 + b0 >= n THEN 1 ELSE b0 END AS b FROM h) "
    "SELECT k, label, load_hp, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM i",
    "split_stratified_rows": "SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) <= round(count(*) OVER (PARTITION BY event_type) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM events",
    "lolo_folds": f"WITH {MANIFEST}, l AS (SELECT DISTINCT load_hp AS load FROM p WHERE load_hp IS NOT NULL) SELECT a.load AS test_load, string_agg(b.load::VARCHAR, ',' ORDER BY b.load) AS trainval_loads FROM l a JOIN l b ON a.load <> b.load GROUP BY a.load",
    "lolo_split": f"WITH {MANIFEST} SELECT CASE WHEN load_hp = 2 THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n, min(load_hp) AS least, max(load_hp) AS most FROM p WHERE load_hp IS NOT NULL GROUP BY ALL",
    "leakage_overlap": f"{_LEAK.format('random', _SPLIT)} UNION ALL {_LEAK.format('file', _BY_FILE)}",
    "accuracy_macro_f1": "WITH l AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT t AS c FROM l UNION SELECT p FROM l), "
    "f AS (SELECT c, 2.0::DOUBLE * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) AS f1 FROM k, l GROUP BY c) "
    f"SELECT {r6('(SELECT count(*) FILTER (t = p)::DOUBLE / count(*) FROM l)')} AS accuracy, {r6('(SELECT avg(f1) FROM f)')} AS f1_macro, (SELECT count(*) FROM l)::BIGINT AS n",
    "standard_scale": f"WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, {r6('(p_size - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END')} AS size, {r6('(p_retailprice - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END')} AS price FROM part, s",
}
