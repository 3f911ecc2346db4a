"""Secret scan with multipart credential linking, in DataFrame operations.

Three base kinds (assignments, access identifiers, long hexadecimal runs) are
always reported. Weak parts, which are ordinary text by themselves, are
reported only together: an opaque run where an identifier or an endpoint lies
within ``SCOPE`` code points of it, and identifiers and endpoints where a
secret does. The parts meet in an interval join: both sides are dealt into
bins of the scope's width, joined on (document, bin) and filtered by
distance; semi-joins, so no pairs are built up.

Spark's functions return what a pattern matched but not where. The text
between the matches is what splitting at the same pattern gives, so positions
are running sums over alternating gap and match lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from botlog.llm import common

#: Code points within which complementary parts belong together.
SCOPE = 200

#: The patterns, in the order in which kinds are listed.
#: Group 2 of an assignment is its value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run has no longer run inside
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?:client_?id|account_?id|key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
ENDPOINT = r"""(?i)(?:https?|jdbc|postgres|mysql|redis|amqp|ftp)://[A-Za-z0-9@:%_.?&=/~+-]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+"""
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"  # reported only with a digit, a capital and a small letter

KINDS = ("assign", "access", "hex", "ident", "endpoint", "opaque")
PATTERNS = (ASSIGN, ACCESS, HEX, IDENT, ENDPOINT, OPAQUE)
N_BASE = 3
SECRETS, OTHERS = (0, 2, 5), (1, 3, 4)


def _found(t: Column, kind: int) -> Column:
    """Array of (kind, place, gap before, length, ok) of all matches of one kind."""
    p = PATTERNS[kind]
    whole = F.regexp_extract_all(t, F.lit(p), F.lit(0))
    if kind == 0:
        ok = F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(2)), lambda g: F.length(g) >= 6)
    elif kind == 5:
        ok = F.transform(whole, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))
    else:
        ok = F.transform(whole, lambda m: F.lit(True))
    gaps = F.transform(F.split(t, p, -1), F.length)
    rows = F.transform(F.arrays_zip(whole.alias("m"), gaps.alias("g"), ok.alias("k")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), x["g"].alias("gap"), F.length(x["m"]).alias("size"), x["k"].alias("ok")))
    # Most texts hold no match: one scan that stops at the first decides.
    return F.when(t.rlike(p), rows).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,ok:boolean>>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, kind, start, end) of every part that stands by itself, weak or
    not; h tells the texts of one id apart. Rows that repeat both give one set."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = (docs.select(F.col(id_col).cast("long").alias("id"), common.text_hash(text_col).alias("h"), t.alias("t"))
             .select("id", "h", F.explode_outer(F.concat(*[_found(F.col("t"), k) for k in range(len(KINDS))])).alias("m"))
             .select("id", "h", "m.*").where("size is not null").distinct())
    before = Window.partitionBy("id", "h", "kind").orderBy("place")
    return (found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
            .where("ok").select("id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def _dealt(rows: DataFrame, reach: int) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(
        F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") - 1 + reach) / SCOPE))))


def _near(rows: DataFrame, others: DataFrame, reach: int, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) one of ``others`` in
    the same text fewer than ``reach`` code points away; 0: overlapping."""
    a = rows.alias("a")
    b = _dealt(others, reach).select(*[F.col(c).alias(f"o_{c}") for c in ("id", "h", "start", "end", "bin")])
    hit = (_dealt(rows, 0).join(b, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h"))
                                & (F.col("bin") == F.col("o_bin")) & (F.col("start") < F.col("o_end") + reach)
                                & (F.col("o_start") < F.col("end") + reach), "left_semi")
           .select("id", "h", "kind", "start").distinct())
    k = hit.select(*[F.col(c).alias(f"k_{c}") for c in hit.columns])
    return a.join(k, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
                  & (F.col("kind") == F.col("k_kind")) & (F.col("start") == F.col("k_start")), how)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, h, kind, start, end) of base spans and linked weak parts, in code
    points, end exclusive. An opaque run that overlaps a base span is that
    span's, not a part of its own."""
    every = common.written(parts(docs, id_col, text_col), "secret-parts")
    base = every.where(F.col("kind") < N_BASE)
    opaque = common.written(_near(every.where("kind = 5"), base, 0, "left_anti"), "secret-opaque")
    secrets = every.where(F.col("kind").isin(0, 2)).union(opaque)
    others = every.where(F.col("kind").isin(*OTHERS))
    linked = (_near(opaque, others, scope, "left_semi")
              .union(_near(every.where(F.col("kind").isin(3, 4)), secrets, scope, "left_semi")))
    return base.union(linked)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, counts of the base kinds,
    base_sha256 and spans (by start, then kind).

    Null and empty texts have no spans; rows with a null or repeated id are
    answered like any other; columns besides id and text are not read; an
    empty table gives no rows."""
    n = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)]
    item = F.struct("start", "kind", "end")
    per = (common.written(secret_spans(docs, id_col, text_col), "secret-spans").groupBy("id", "h")
           .agg(*n, F.sort_array(F.collect_list(item)).alias("s")))
    per = per.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), *[f"n_{k}" for k in KINDS[:N_BASE]],
                     _text(F.filter("s", lambda x: x["kind"] < N_BASE)).alias("base"), _text(F.col("s")).alias("spans"))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), common.text_hash(text_col).alias("h"))
    return (keys.join(per, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")), "left")
            .select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:N_BASE]],
                    F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans")))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (spans that
    overlap or touch by one) and n_chars, where there is one, set anew.
    Other rows and columns stay as they are."""
    spans = common.written(secret_spans(docs), "secret-spans")
    w = Window.partitionBy("id", "h").orderBy("start", "end")
    merged = (spans.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
              .groupBy("id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .withColumn("from", F.lag("end", 1, 0).over(Window.partitionBy("id", "h").orderBy("start")))
              .groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("cuts")))
    k_id, k_h, cuts, masked = (common.unused(docs.columns, c) for c in ("k_id", "k_h", "cuts", "masked"))
    merged = merged.select(F.col("id").alias(k_id), F.col("h").alias(k_h), F.col("cuts").alias(cuts))
    t = F.col("text")
    pieces = F.transform(cuts, lambda c: t.substr((c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")))
    tail = t.substr((F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(t))
    clean = F.when(F.col(cuts).isNull(), t).otherwise(
        F.concat(F.array_join(F.concat(pieces, F.array(F.lit(""))), mask), tail))
    joined = docs.join(merged, docs["doc_id"].cast("long").eqNullSafe(F.col(k_id))
                       & (common.text_hash("text") == F.col(k_h)), "left")
    out = joined.withColumn(masked, clean)
    new = {"text": F.col(masked)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(masked).cast(kind))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


@common.query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans and linked weak parts."""
    return scan(common.table(spark, sf_dir, "documents"))


def _sql_kind(k: int) -> str:
    p = PATTERNS[k].replace("'", "''")
    ok = {0: f"list_transform(regexp_extract_all(t, '{p}', 2), lambda x: length(x) >= 6)",
          5: "list_transform(m, lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]'))",
          }.get(k, "list_transform(m, lambda x: true)")
    return f"""SELECT r, {k} AS kind, unnest(range(len(m))) AS place, unnest(list_transform(m, lambda x: length(x))) AS size,
      unnest(list_transform(string_split_regex(t, '{p}')[1:len(m)], lambda x: length(x))) AS gap, unnest({ok}) AS ok
    FROM (SELECT r, t, regexp_extract_all(t, '{p}', 0) AS m FROM d) WHERE len(m) > 0"""


_NAMES = "['assign','access','hex','ident','endpoint','opaque'][kind + 1]"
_LIST = f"string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_sql_kind(k) for k in range(len(KINDS)))}),
placed AS (SELECT r, kind, size, ok, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY place) AS e FROM found),
part AS (SELECT r, kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE ok),
own AS (SELECT * FROM part a WHERE kind < 5 OR NOT EXISTS (
  SELECT 1 FROM part b WHERE b.r = a.r AND b.kind < 3 AND a.s < b.e AND b.s < a.e)),
linked AS (SELECT * FROM own a WHERE kind < 3 OR EXISTS (
  SELECT 1 FROM own b WHERE b.r = a.r AND a.s < b.e + {SCOPE} AND b.s < a.e + {SCOPE}
    AND CASE WHEN a.kind = 5 THEN b.kind IN (1, 3, 4) ELSE b.kind IN (0, 2, 5) END)),
per AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, {_LIST} AS spans
  FROM linked GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""
