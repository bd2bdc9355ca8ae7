"""Secret scans: base patterns, and weak parts reported only where their complements stand near (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unplaced, written

#: Kinds in the order in which they are listed: the three of the base, then weak parts.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint", "short", "mixed", "long")
N_BASE = 3
ROLE = {"access": "ident", "ident": "ident", "endpoint": "endpoint"}  # all others are secrets
#: Patterns, each with the group that is measured and the kinds that its matches may be: least and most characters of that group (fixed values).
#: Weak parts are an account or client name, an address of a service, an assigned value too short for ``assign``, and a run of 12 characters or
#: more with letters of both cases and digits, by its length.
PATTERNS = (
    (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, (("assign", 12, None), ("short", 1, 11))),
    (r"AKIA[A-Z0-9]+", 0, (("access", 18, None),)),
    (r"[0-9a-f]{16,}", 0, (("hex", 16, None),)),
    (r"""(?i)(access_?key_?id|client_?id|account|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]+)""", 2, (("ident", 4, None),)),
    (r"[A-Za-z0-9+/_-]{12,}", 0, (("mixed", 12, 31), ("key", 32, 128), ("long", 129, None))),
    (r"""(?i)(https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|ssh)://[A-Za-z0-9._:@/?&=%-]+""", 0, (("endpoint", 10, None),)),
)
#: Runs that need letters of both cases and digits, and that count for nothing within an assigned value, an access id or an identifier.
RUNS, COVERS = ("key", "mixed", "long"), ("assign", "access", "ident")
SCOPE = 256


def _numbers(kinds) -> list[int]:
    return [KINDS.index(k) for k in kinds]


def _of(f):
    return lambda s: f(s)  # one parameter: a second one would get the index


def _parts(text):
    """Per pattern with matches: (pattern's number, gaps between matches, lengths of matches, the kind of each match or null)."""
    out = []
    for number, (pattern, group, kinds) in enumerate(PATTERNS):
        found = F.regexp_extract_all(text, F.lit(pattern), 0)

        def kind_of(match, pattern=pattern, group=group, kinds=kinds):
            c = F.regexp_extract(match, pattern, group) if group else match
            size, kind = F.length(c), None
            for name, least, most in kinds:
                ok = size >= least if most is None else size.between(least, most)
                kind = F.when(ok, F.lit(KINDS.index(name))) if kind is None else kind.when(ok, F.lit(KINDS.index(name)))
            return F.when(c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]"), kind) if kinds[0][0] in RUNS else kind

        part = F.struct(
            F.lit(number).alias("pattern"),
            F.transform(F.split(text, pattern, -1), lambda s: F.length(s)).alias("gaps"),
            F.transform(found, lambda s: F.length(s)).alias("lens"),
            F.transform(found, _of(kind_of)).alias("kinds"),
        )
        out.append(F.when(F.size(found) > 0, part))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive. Base kinds always count. The weak kinds
    are linked by an interval join within the document: a weak secret (a short assigned value, a mixed run of 12 characters or more)
    needs an identifier, a weak
    identifier a secret, and an endpoint both, at most ``scope`` code points from start to start (two
    running extremes over the parts in order, so the work is linear in the parts of a document). Null
    and empty texts have no spans; repeated rows each get their result; other columns aren't carried.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), _parts(body).alias("parts"))
    keyed = written(keyed, "secret-parts")
    one = keyed.where(F.size("parts") > 0).dropDuplicates(["doc_id", "h"])
    one = one.select("doc_id", "h", F.explode("parts").alias("p")).select("doc_id", "h", "p.*")
    one = one.select("doc_id", "h", "pattern", F.posexplode(F.arrays_zip("gaps", "lens", "kinds")).alias("at", "x"))
    order = W.partitionBy("doc_id", "h", "pattern").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("x.gaps") + F.coalesce("x.lens", F.lit(0))).over(order)
    found = one.withColumn("end", end).where("x.kinds is not null")
    found = found.select("doc_id", "h", F.col("x.kinds").alias("kind"), (F.col("end") - F.col("x.lens")).alias("start"), "end")

    role = F.element_at(F.array(*[F.lit(ROLE.get(k, "secret")) for k in KINDS]), F.col("kind") + 1)
    found = found.withColumn("role", role)
    before = W.partitionBy("doc_id", "h").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("doc_id", "h").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)
    # a run within an assigned value, an access id or an identifier is that part and no complement of it
    cover = F.max(F.when(F.col("kind").isin(_numbers(COVERS)), F.col("end"))).over(before)
    runs = F.col("kind").isin(_numbers(RUNS))
    found = found.withColumn("cover", cover).where(~runs | F.coalesce(F.col("cover") <= F.col("start"), F.lit(True))).drop("cover")
    near = {}
    for r in ("secret", "ident"):
        at = F.when(F.col("role") == r, F.col("start"))
        near[f"prev_{r}"], near[f"next_{r}"] = F.max(at).over(before), F.min(at).over(after)
    found = found.withColumns(near)
    has = lambda r: F.coalesce(F.col("start") - F.col(f"prev_{r}") <= scope, F.lit(False)) | F.coalesce(
        F.col(f"next_{r}") - F.col("start") <= scope, F.lit(False)
    )
    linked = (
        F.when(F.col("kind") < N_BASE, F.lit(True))
        .when(F.col("role") == "secret", has("ident"))
        .when(F.col("role") == "ident", has("secret"))
        .otherwise(has("secret") & has("ident"))
    )
    spans = found.where(linked).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    spans = spans.select(F.col("doc_id").alias("_id"), unplaced(F.col("h"), "bigint").alias("_h"), "s")
    out = keyed.select("doc_id", "h").join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    s = F.coalesce(F.col("s"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.filter(s, lambda x: x["kind"] < N_BASE)), 256).alias("base_sha256"), told(s).alias("spans"),
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = []
    for number, (pattern, group, kinds) in enumerate(PATTERNS):
        p = quoted(pattern)
        told = " ".join(f"WHEN length(c) >= {least}{f' AND length(c) <= {most}' if most else ''} THEN {KINDS.index(k)}" for k, least, most in kinds)
        if kinds[0][0] in RUNS:
            told = f"WHEN NOT (regexp_matches(c, '[a-z]') AND regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[0-9]')) THEN NULL {told}"
        found = f"""SELECT r, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(c) AS c, unnest(g[1:len(m)]) AS g FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS m,
          regexp_extract_all(t, {p}, {group}) AS c, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))"""
        each.append(f"SELECT r, {number} AS pattern, i, length(m) AS len, length(g) AS gap, CASE {told} END AS kind FROM ({found})")
    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    listed = lambda kinds: "(" + ", ".join(map(str, _numbers(kinds))) + ")"
    idents = [k for k, v in ROLE.items() if v == "ident"]
    near = lambda role: f"""EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.role = '{role}' AND abs(y.s - x.s) <= {SCOPE})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
p AS (SELECT r, kind, len, sum(len + gap) OVER (PARTITION BY r, pattern ORDER BY i) AS e FROM m),
c AS (SELECT r, kind, e - len AS s, e, max(CASE WHEN kind IN {listed(COVERS)} THEN e END) OVER (PARTITION BY r ORDER BY e - len RANGE UNBOUNDED PRECEDING) AS cover
      FROM p WHERE kind IS NOT NULL),
f AS (SELECT r, kind, s, e, CASE WHEN kind IN {listed(idents)} THEN 'ident' WHEN kind = {KINDS.index("endpoint")} THEN 'endpoint' ELSE 'secret' END AS role
      FROM c WHERE kind NOT IN {listed(RUNS)} OR coalesce(cover <= s, true)),
l AS (SELECT r, kind, s, e, {names}[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS told FROM f x
      WHERE kind < {N_BASE} OR (role = 'secret' AND {near("ident")}) OR (role = 'ident' AND {near("secret")})
         OR (role = 'endpoint' AND {near("ident")} AND {near("secret")})),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg(told, ',' ORDER BY s, kind) FILTER (kind < {N_BASE}) AS base, string_agg(told, ',' ORDER BY s, kind) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


OP5_SQL = _sql()
