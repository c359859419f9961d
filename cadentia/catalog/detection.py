"""Queries on the repeated-vector view: profiles, scores, evaluation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog.registry import query
from cadentia.catalog.views import (
    FEATURES, K_IMPOSTOR, N_ENROL, OBS, SCORES, WIDTH, curve_sql, obs, table,
)
from cadentia.operators import checks as C
from cadentia.operators import evaluation as E
from cadentia.operators import profiles as P
from cadentia.operators import splits as S
from cadentia.session import scratch_path
from cadentia.sources import files as files_source
from cadentia.sources import observations as O

ORDER = ["vec_id"]


def split(spark, folder):
    return S.enrolment_split(obs(spark, folder), "subject", ORDER, N_ENROL)


def enrolled(spark, folder):
    return split(spark, folder).where(F.col("role") == "enrolment")


def fitted(spark, folder, scaling="mad"):
    return P.fit_profiles(enrolled(spark, folder), "subject", scaling=scaling)


def scores(spark, folder, scaling="mad"):
    """The protocol's scores; they are counted where they are formed and stored by no query."""
    return E.protocol_scores(
        obs(spark, folder), "subject", ORDER, scaling=scaling, n_enrol=N_ENROL, k=K_IMPOSTOR
    )


def genuine_rows(spark, folder):
    return split(spark, folder).where(F.col("role") == "genuine")


def wide(spark, folder):
    return O.unpack_vector(obs(spark, folder), "features", WIDTH)


def long_form(df, array, name, keys=("subject",)):
    """One array per row to rows (keys, feature, value)."""
    feature = F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature")
    cells = df.select(*keys, F.posexplode(array))
    return cells.select(*keys, feature, F.round("col", 6).alias(name))


def rounded(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


@query("read_observations", """
SELECT label AS subject, vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def _(spark, folder):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return obs(spark, folder).select("subject", "vec_id", F.round(total, 6).alias("total"))


@query("feature_columns", """
SELECT 'f' || (i - 1) AS feature, CAST(i - 1 AS INTEGER) AS position, count(x) AS filled, round(min(x), 6) AS least, round(max(x), 6) AS most
FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY i""")
def _(spark, folder):
    names = O.feature_columns(wide(spark, folder).drop("features"), ("f",))
    cells = [
        F.struct(F.lit(n).alias("feature"), F.lit(i).alias("position"), F.col(n).alias("x")) for i, n in enumerate(names)
    ]
    rows = wide(spark, folder).select(F.inline(F.array(*cells)))
    return rows.groupBy("feature", "position").agg(
        F.count("x").alias("filled"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most")
    )


@query("select_features", """
SELECT label AS subject, vec_id, round(embedding[1]::DOUBLE, 6) AS f0, round(embedding[6]::DOUBLE, 6) AS f5 FROM embeddings""")
def _(spark, folder):
    some = O.select_features(wide(spark, folder), ["subject", "vec_id"], ["f0", "f5"])
    return some.select("subject", "vec_id", rounded("f0"), rounded("f5"))


@query("subject_filter", """
SELECT label AS subject, count(*) AS own_rows, (SELECT count(*) FROM embeddings) - count(*) AS other_rows
FROM embeddings GROUP BY 1""")
def _(spark, folder):
    rows = obs(spark, folder).groupBy("subject").agg(F.count("*").alias("own_rows"))
    total = rows.agg(F.sum("own_rows").alias("n"))
    return rows.join(F.broadcast(total)).select(  # one row
        "subject", "own_rows", (F.col("n") - F.col("own_rows")).alias("other_rows")
    )


@query("subjects", "SELECT DISTINCT label AS subject FROM embeddings")
def _(spark, folder):
    return S.subjects(obs(spark, folder))


@query("rep_rank", "WITH " + OBS + " SELECT subject, vec_id, rr AS rep_rank FROM obs")
def _(spark, folder):
    return S.rep_rank(obs(spark, folder), "subject", ORDER).select("subject", "vec_id", "rep_rank")


@query("canonical_sort", "WITH " + OBS + " SELECT subject, vec_id FROM obs ORDER BY 1, 2")
def _(spark, folder):
    return S.canonical_sort(obs(spark, folder), "subject", ORDER).select("subject", "vec_id")


@query("enrolment_split", "WITH " + OBS + """
SELECT subject, vec_id, CASE WHEN rr <= 20 THEN 'enrolment' ELSE 'genuine' END AS role FROM obs""")
def _(spark, folder):
    return split(spark, folder).select("subject", "vec_id", "role")


@query("insufficient_subjects", "SELECT label AS subject, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) <= 50")
def _(spark, folder):
    return S.insufficient_subjects(obs(spark, folder), "subject", 50)


@query("head_per_subject", "WITH " + OBS + " SELECT subject, vec_id, CAST(rr AS INTEGER) AS head_rank FROM obs WHERE rr <= 5")
def _(spark, folder):
    return S.head_per_subject(obs(spark, folder), "subject", ORDER, K_IMPOSTOR).select(
        "subject", "vec_id", "head_rank"
    )


@query("too_few_rows", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) < 2")
def _(spark, folder):
    rows = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return P.too_few_rows(rows, ["user_id", "day"])


@query("width_check", "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE len(embedding) <> 63")
def _(spark, folder):
    wrong = P.wrong_width(table(spark, folder, "embeddings"), "embedding", 63)
    return wrong.select("vec_id", F.col("width").cast("long").alias("width"))


@query("null_audit", """
WITH n AS (SELECT count(*) - count(o_orderkey) AS a, count(*) - count(o_custkey) AS b, count(*) - count(o_orderstatus) AS c,
                  count(*) - count(o_totalprice) AS d, count(*) - count(o_orderdate) AS e, count(*) - count(o_orderpriority) AS f FROM orders)
SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
  unnest([a, b, c, d, e, f]) AS nulls FROM n""")
def _(spark, folder):
    return C.null_audit(table(spark, folder, "orders"))


@query("numeric_coercion", "SELECT vec_id, " + ", ".join(
    f"round(embedding[{i + 1}]::DOUBLE, 9) AS f{i}" for i in range(WIDTH)) + " FROM embeddings")
def _(spark, folder):
    return wide(spark, folder).select("vec_id", *[rounded(f"f{i}", 9) for i in range(WIDTH)])


@query("verify_dataset", """
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT 'subjects' AS check_name, 10::BIGINT AS expected, count(*) AS actual, count(*) = 10 AS ok FROM s
UNION ALL SELECT 'rows', 500, CAST(sum(n) AS BIGINT), sum(n) = 500 FROM s
UNION ALL SELECT 'features', 64, max(len(embedding)), max(len(embedding)) = 64 FROM embeddings
UNION ALL SELECT 'nulls', 0, count(*), count(*) = 0 FROM embeddings WHERE vec_id IS NULL OR label IS NULL OR embedding IS NULL
UNION ALL SELECT 'subjects with another row count', 0, count(*), count(*) = 0 FROM s WHERE n <> 50""")
def _(spark, folder):
    expected = C.Expectations(subjects=10, rows=500, features=WIDTH, rows_per_subject=50)
    return C.verify_dataset(wide(spark, folder), "subject", FEATURES, expected)


@query("group_sizes", """
SELECT count(*) AS subjects, min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)""")
def _(spark, folder):
    return C.group_sizes(obs(spark, folder), "subject")


@query("subject_count", "SELECT count(DISTINCT label) AS subjects, count(*) AS rows FROM embeddings")
def _(spark, folder):
    per_subject = obs(spark, folder).groupBy("subject").agg(F.count("*").alias("n"))
    return per_subject.agg(F.count("*").alias("subjects"), F.sum("n").alias("rows"))


@query("rejected_rows", """
SELECT event_id, 'gap is null' AS reason FROM (
  SELECT event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL""")
def _(spark, folder):
    from cadentia.catalog.views import sessions

    return C.rejected_rows(sessions(spark, folder), ["event_id"], ["gap", "value"])


@query("finite_vectors", "SELECT count(*) AS finite_vectors FROM embeddings WHERE list_bool_and([isfinite(x) FOR x IN embedding])")
def _(spark, folder):
    return C.finite_vectors(obs(spark, folder), "features").agg(F.count("*").alias("finite_vectors"))


@query("verify_files")
def _(spark, folder):
    path = folder.rstrip("/")
    manifest = files_source.file_digests(spark, path, "*.parquet")
    return files_source.verify_files(spark, path, manifest, "*.parquet").select(
        "file", "bytes", "sha256", "status"
    )


@query("verify_spoilt_manifest", """
SELECT view_name || '.parquet' AS file, CASE view_name WHEN 'customer' THEN 'unexpected' WHEN 'nation' THEN 'size mismatch'
  WHEN 'region' THEN 'checksum mismatch' ELSE 'ok' END AS status FROM duckdb_views() WHERE NOT internal
UNION ALL SELECT 'gone.parquet', 'missing'""")
def _(spark, folder):
    """The folder against a manifest that differs from it in four ways."""
    path = folder.rstrip("/")
    true = files_source.file_digests(spark, path, "*.parquet").where(F.col("file") != "customer.parquet")
    cut = F.when(F.col("file") == "nation.parquet", F.col("bytes") - 1).otherwise(F.col("bytes"))
    altered = F.when(F.col("file") == "region.parquet", F.reverse("sha256")).otherwise(F.col("sha256"))
    gone = spark.range(1).select(F.lit("gone.parquet").alias("file"), F.lit(1).cast("long").alias("bytes"), F.lit("").alias("sha256"))
    manifest = true.select("file", cut.alias("bytes"), altered.alias("sha256")).unionByName(gone)
    return files_source.verify_files(spark, path, manifest, "*.parquet").select("file", "status")


PROFILE_KEYS = "SELECT subject, 'f' || pos AS feature, "


@query("fit_centre", "WITH " + OBS + PROFILE_KEYS + "round(c, 6) AS centre FROM prof")
def _(spark, folder):
    return long_form(P.fit_centres(enrolled(spark, folder), "subject"), "centre", "centre")


@query("fit_mad", "WITH " + OBS + PROFILE_KEYS + "round(raw_mad, 6) AS mad FROM prof")
def _(spark, folder):
    return long_form(P.fit_spreads(enrolled(spark, folder), "subject"), "mad", "mad")


@query("fit_std", "WITH " + OBS + PROFILE_KEYS + "round(sd, 6) AS std FROM prof")
def _(spark, folder):
    spreads = P.fit_spreads(enrolled(spark, folder), "subject", scalings=("std",))
    return long_form(spreads, "std", "std")


@query("dispersion_floor", "WITH " + OBS + PROFILE_KEYS + "round(greatest(raw_mad, 0.15), 6) AS dispersion FROM prof")
def _(spark, folder):
    floored = P.fit_profiles(enrolled(spark, folder), "subject", floor=0.15)
    return long_form(floored, "dispersion", "dispersion")


@query("floored_count", "WITH " + OBS + """
SELECT subject, CAST(sum(CASE WHEN raw_mad < 0.09 THEN 1 ELSE 0 END) AS INTEGER) AS floored_features FROM prof GROUP BY 1""")
def _(spark, folder):
    floored = P.fit_profiles(enrolled(spark, folder), "subject", floor=0.09)
    return floored.select("subject", "floored_features")


@query("reference_profile", "WITH " + OBS + """
SELECT subject, 'mad' AS scaling, 64::INTEGER AS width, round(sum(c), 6) AS centre_sum, round(sum(mad), 6) AS dispersion_sum
FROM prof GROUP BY 1""")
def _(spark, folder):
    def total(name):
        return F.round(F.aggregate(name, F.lit(0.0), lambda a, x: a + x), 6)

    return fitted(spark, folder).select(
        "subject",
        "scaling",
        F.size("centre").alias("width"),
        total("centre").alias("centre_sum"),
        total("dispersion").alias("dispersion_sum"),
    )


@query("deviations", "WITH " + OBS + """
SELECT l.subject, vec_id, 'f' || l.pos AS feature, round((x - c) / mad, 6) AS deviation
FROM cells l JOIN prof p ON l.subject = p.subject AND l.pos = p.pos WHERE rr > 20""")
def _(spark, folder):
    devs = P.deviations(genuine_rows(spark, folder), fitted(spark, folder), "subject")
    return long_form(devs, "deviations", "deviation", ("subject", "vec_id"))


@query("anomaly_score", "WITH " + SCORES + " SELECT subject, vec_id, round(score, 6) AS score FROM scores WHERE label = 0")
def _(spark, folder):
    scored = P.anomaly_score(genuine_rows(spark, folder), fitted(spark, folder), "subject")
    return scored.select("subject", "vec_id", rounded("score"))


@query("score_sessions", "WITH " + SCORES + """
SELECT subject, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score
FROM scores WHERE label = 0 GROUP BY 1""")
def _(spark, folder):
    scored = P.anomaly_score(genuine_rows(spark, folder), fitted(spark, folder), "subject")
    return scored.groupBy("subject").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.max("score"), 6).alias("max_score"),
    )


@query("top_deviations", "WITH " + OBS + """,
dev AS (SELECT l.subject, vec_id, l.pos, (x - c) / mad AS dv
        FROM cells l JOIN prof p ON l.subject = p.subject AND l.pos = p.pos WHERE rr > 20),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(dv) DESC, pos) AS rnk FROM dev)
SELECT subject, vec_id, CAST(rnk AS INTEGER) AS rank, 'f' || pos AS feature, round(dv, 6) AS deviation FROM rk WHERE rnk <= 3""")
def _(spark, folder):
    top = P.top_deviations(
        genuine_rows(spark, folder), fitted(spark, folder), "subject", FEATURES
    )
    return top.select("subject", "vec_id", "rank", "feature", rounded("deviation"))


@query("impostor_pairs", "WITH " + SCORES + """
SELECT subject, count(*) AS pairs, round(sum(score), 5) AS total_score, round(min(score), 6) AS closest
FROM scores WHERE label = 1 GROUP BY 1""")
def _(spark, folder):
    heads = S.head_per_subject(obs(spark, folder), "subject", ORDER, K_IMPOSTOR)
    pairs = E.impostor_pairs(heads, fitted(spark, folder), "subject")
    return pairs.groupBy("subject").agg(
        F.count("*").alias("pairs"),
        F.round(F.sum("score"), 5).alias("total_score"),
        F.round(F.min("score"), 6).alias("closest"),
    )


@query("label_scores", "WITH " + SCORES + " SELECT subject, label, round(score, 6) AS score FROM scores")
def _(spark, folder):
    return scores(spark, folder).select("subject", "label", rounded("score"))


@query("split_disjoint", "WITH " + OBS + """
SELECT count(*) AS shared_vectors FROM (SELECT embedding FROM obs GROUP BY embedding HAVING min(rr) <= 20 AND max(rr) > 20)""")
def _(spark, folder):
    shared = S.split_overlap(split(spark, folder), "features")
    return shared.agg(F.count("*").alias("shared_vectors"))


MAD_CURVE = "WITH " + SCORES + curve_sql("score", "mad")
BOTH_CURVES = MAD_CURVE + curve_sql("score_std", "std")


@query("error_curve", MAD_CURVE + " SELECT subject, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM curve_mad")
def _(spark, folder):
    curve = E.error_curve(scores(spark, folder))
    return curve.select("subject", rounded("threshold"), rounded("far"), rounded("frr"))


@query("sorted_curve", MAD_CURVE + " SELECT subject, round(threshold, 6) AS threshold, round(far, 6) AS far FROM curve_mad ORDER BY 1, 2")
def _(spark, folder):
    curve = E.sorted_curve(E.error_curve(scores(spark, folder)))
    return curve.select("subject", rounded("threshold"), rounded("far"))


@query("equal_error_rate", MAD_CURVE + " SELECT subject, round(eer, 6) AS eer FROM eer_mad")
def _(spark, folder):
    return E.equal_error_rate(scores(spark, folder)).select("subject", rounded("eer"))


def eers(spark, folder, scaling="mad"):
    return E.evaluate(
        obs(spark, folder), "subject", ORDER, scaling=scaling, n_enrol=N_ENROL, k=K_IMPOSTOR
    )


def both_eers(spark, folder):
    return E.evaluate_scalings(obs(spark, folder), "subject", ORDER, n_enrol=N_ENROL, k=K_IMPOSTOR)


@query("evaluate_std", BOTH_CURVES + " SELECT subject, round(eer, 6) AS eer FROM eer_std")
def _(spark, folder):
    return eers(spark, folder, "std").select("subject", rounded("eer"))


@query("compare_scalings", BOTH_CURVES + """
SELECT m.subject, round(m.eer, 6) AS eer_mad, round(s.eer, 6) AS eer_std FROM eer_mad m JOIN eer_std s ON m.subject = s.subject""")
def _(spark, folder):
    both = both_eers(spark, folder)
    return both.select("subject", rounded("eer_mad"), rounded("eer_std"))


@query("write_eer_table", BOTH_CURVES + """
SELECT m.subject, round(m.eer, 6) AS eer_mad, round(s.eer, 6) AS eer_std FROM eer_mad m JOIN eer_std s ON m.subject = s.subject""")
def _(spark, folder):
    both = both_eers(spark, folder)
    path = O.write_eer_table(both, scratch_path(spark, "eer"))
    back = O.read_observations(spark, path, both.select("subject", "eer_mad", "eer_std").schema)
    return back.select("subject", rounded("eer_mad"), rounded("eer_std"))


@query("mean_eer", MAD_CURVE + " SELECT round(avg(eer), 6) AS mean_eer FROM eer_mad")
def _(spark, folder):
    return E.mean_eer(eers(spark, folder)).select(rounded("mean_eer"))


@query("std_eer", MAD_CURVE + " SELECT round(stddev_pop(eer), 6) AS std_eer FROM eer_mad")
def _(spark, folder):
    return E.std_eer(eers(spark, folder)).select(rounded("std_eer"))


@query("eer_summary", MAD_CURVE + """
SELECT count(*) AS subjects, round(avg(eer), 6) AS mean_eer, round(stddev_pop(eer), 6) AS std_eer,
       round(min(eer), 6) AS min_eer, round(max(eer), 6) AS max_eer FROM eer_mad""")
def _(spark, folder):
    summary = E.eer_summary(eers(spark, folder))
    return summary.select("subjects", *[rounded(c) for c in summary.columns[1:]])


FAR_COLUMNS = ["far_at_frr_0_01", "far_at_frr_0_05", "far_at_frr_0_10", "far_at_frr_0_20"]
FAR_AT = MAD_CURVE + """, fa AS (SELECT subject, min(far) FILTER (WHERE frr <= 0.01) AS far_at_frr_0_01,
  min(far) FILTER (WHERE frr <= 0.05) AS far_at_frr_0_05, min(far) FILTER (WHERE frr <= 0.10) AS far_at_frr_0_10,
  min(far) FILTER (WHERE frr <= 0.20) AS far_at_frr_0_20 FROM curve_mad GROUP BY 1) """


@query("far_at_frr", FAR_AT + "SELECT subject, " + ", ".join(f"round({c}, 6) AS {c}" for c in FAR_COLUMNS) + " FROM fa")
def _(spark, folder):
    found = E.far_at_frr(E.error_curve(scores(spark, folder)))
    return found.select("subject", *[rounded(c) for c in FAR_COLUMNS])


@query("operating_points", FAR_AT + "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FAR_COLUMNS) + " FROM fa")
def _(spark, folder):
    found = E.operating_points(E.far_at_frr(E.error_curve(scores(spark, folder))))
    return found.select(*[rounded(c) for c in FAR_COLUMNS])


@query("rates_at_threshold", MAD_CURVE + """,
near AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(threshold - 75.0), threshold) AS rn FROM curve_mad)
SELECT subject, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM near WHERE rn = 1""")
def _(spark, folder):
    at = E.rates_at_threshold(E.error_curve(scores(spark, folder)), 75.0)
    return at.select("subject", rounded("threshold"), rounded("far"), rounded("frr"))


@query("baseline_delta", BOTH_CURVES + """,
m AS (SELECT (SELECT avg(eer) FROM eer_mad) AS a, (SELECT avg(eer) FROM eer_std) AS b)
SELECT round(a, 6) AS mean_mad, round(b, 6) AS mean_std, round(a - 0.0962, 6) AS delta_mad, round(b - 0.0962, 6) AS delta_std,
       CASE WHEN a < b THEN 'mad' ELSE 'std' END AS better, round(abs(a - b), 6) AS margin FROM m""")
def _(spark, folder):
    both = both_eers(spark, folder)
    d = E.baseline_delta(both)
    numbers = [c for c in d.columns if c != "better"]
    return d.select(*[rounded(c) for c in numbers], "better")
