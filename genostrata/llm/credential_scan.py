"""Secret scans with multipart linking, in DataFrame functions only.

Strong patterns stand alone. Weak parts (identifiers, short or loosely named secrets, runs of
letters without a label, endpoints) mean little by themselves; an interval join within a document links each of them
to complementary parts that start within SCOPE characters, and only linked ones are
reported. The join meets on cells of SCOPE characters, each summed up to the first and last
start of a role beforehand, so a text full of candidates costs no more than its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, read

SCOPE = 256
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""

#: kind: (pattern, least length, group whose length counts, role). In order of listing.
KINDS = {
    "assign": (rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 8, 2, "secret"),
    # A run that is long enough is one match of the open-ended pattern too, and shorter ones are dropped.
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0, "identifier"),
    "hex": (r"[0-9a-f]{32,}", 32, 0, "none"),
    # The secret half of an access key is consumed without a counted group, so that it is no identifier.
    "user": (rf"(?i)(?:secret_?access_?key{_VALUE}[A-Za-z0-9+/_.=-]+|(?:user_?name|user_?id|login|account(?:_?name)?|client_?id|access_?key(?:_?id)?){_VALUE}([A-Za-z0-9+/_.@-]+))", 3, 1, "identifier"),
    "weak": (rf"(?i)(pwd|passphrase|passcode|private_?key|credential|auth_?key|secret_?access_?key|secret_?key|account_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 6, 2, "secret"),
    "endpoint": (r"(?i)[a-z][a-z0-9+.-]*://[^\x00-\x20\"'<>]+", 8, 0, "endpoint"),
    # A run of letters without any label, as long as keys are; only what looks drawn at random counts.
    "bare": (r"[A-Za-z0-9+/]{32,}={0,2}", 32, 0, "secret"),
}
#: The longest run of the kind bare, and what each must have.
LONGEST_BARE, MIXED = 66, ("[A-Z]", "[a-z]", "[0-9]")
BASE = ("assign", "access", "hex")
#: Values of the assign pattern that are too short to stand alone are weak secrets from here on.
SHORT_ASSIGN = 4
#: What must be in scope for a weak part of a role.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def _measures(text: Column, kind: str) -> Column:
    """Lengths of a kind's matches, of the stretches before them, and of the counted group."""
    pattern, _, group, _ = KINDS[kind]
    size = lambda a: F.transform(a, lambda s: F.length(s))
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = size(match if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    if kind == "bare":
        drawn = lambda s: reduce(Column.__and__, [s.rlike(m) for m in MIXED], F.length(s) <= LONGEST_BARE)
        counted = F.transform(match, lambda s: F.when(drawn(s), F.length(s)).otherwise(0))
    zipped = F.arrays_zip(F.slice(size(F.split(text, pattern)), F.lit(1), F.size(match)).alias("gap"), size(match).alias("len"), counted.alias("counted"))
    return F.when(text.rlike(pattern), zipped)


def parts(measured: DataFrame) -> DataFrame:
    """(rid, kind, place, role, start, end, strong) of every candidate, in code points."""
    found = None
    for place, (kind, (_, least, _, role)) in enumerate(KINDS.items()):
        rows = measured.where(F.col(kind).isNotNull()).select("rid", F.posexplode(kind).alias("k", "m"))
        upto = Window.partitionBy("rid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto)).withColumn("start", F.col("end") - F.col("m.len"))
        strong = F.lit(kind in BASE) & (F.col("m.counted") >= least)
        enough = F.col("m.counted") >= (SHORT_ASSIGN if kind == "assign" else least)
        rows = rows.where(enough).select("rid", F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(role).alias("role"), "start", "end", strong.alias("strong"))
        found = rows if found is None else found.unionByName(rows)
    return found


def uncovered(candidates: DataFrame) -> DataFrame:
    """``candidates`` without bare runs that lie in a span of another kind: the value of a label is no run of its own."""
    upto = Window.partitionBy("rid").orderBy("start")
    reach = F.max(F.when(F.col("kind") != "bare", F.col("end"))).over(upto)
    return candidates.withColumn("reach", reach).where((F.col("kind") != "bare") | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def linked(candidates: DataFrame) -> DataFrame:
    """The weak parts that have what their role NEEDS within SCOPE."""
    cell = F.expr(f"start div {SCOPE}")
    near = candidates.where("role <> 'none'").groupBy("rid", cell.alias("cell"), "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    near = near.withColumnRenamed("role", "other")
    weak = candidates.where("NOT strong")
    asked = weak.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = asked.join(near, ["rid", "cell"]).where((F.col("hi") >= F.col("start") - SCOPE) & (F.col("lo") <= F.col("start") + SCOPE) & (F.col("other") != F.col("role")))
    seen = met.groupBy("rid", "kind", "place", "role", "start", "end").agg(F.collect_set("other").alias("others"))
    enough = F.lit(False)
    for role, others in NEEDS.items():
        enough |= (F.col("role") == role) & (F.size(F.array_intersect("others", F.array(*map(F.lit, others)))) == len(others))
    return seen.where(enough).select("rid", "kind", "place", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and found, an array of (kind, start, end, strong) in order, for every row.

    start and end are code points, end exclusive; order is by start, then kind as in KINDS.
    A null text counts as empty. Matches of a kind do not overlap, the leftmost first; texts
    are scanned whole. Repeated rows are each answered, other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), *(_measures(F.col("t"), k).alias(k) for k in KINDS))
    with Scratch(docs.sparkSession) as scratch:
        measured = scratch.table(rows)
        candidates = scratch.table(uncovered(parts(measured)))
        spans = candidates.where("strong").select("rid", "kind", "place", "start", "end", F.lit(True).alias("strong"))
        spans = spans.unionByName(linked(candidates).withColumn("strong", F.lit(False)))
        listed = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "kind", "strong"))).alias("found"))
        found = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strong"].alias("strong")))
        out = measured.select("rid", "doc_id").join(listed, "rid", "left").select("doc_id", F.coalesce(found, F.array()).alias("found"))
        return scratch.table(out, keep=True)


def op4_credential_linking(spark, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    rows = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["strong"])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["strong"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    linked_ = (F.size("found") - F.size(base)).cast("long").alias("n_linked")
    return rows.select("doc_id", *map(count, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"), linked_)


def _sql() -> str:
    kinds = []
    for place, (kind, (pattern, least, group, role)) in enumerate(KINDS.items()):
        p = pattern.replace("'", "''")
        drawn = " AND ".join([f"length(x) <= {LONGEST_BARE}", *(f"regexp_matches(x, '{m}')" for m in MIXED)]) if kind == "bare" else "TRUE"
        floor = SHORT_ASSIGN if kind == "assign" else least
        kinds.append(f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, '{role}' AS role, counted, len,
         CAST(sum(gap + len) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS end_, {str(kind in BASE).upper()} AND counted >= {least} AS strong, {floor} AS floor_
  FROM (SELECT doc_id, unnest(range(len(m))) AS k, unnest([length(x) for x in m]) AS len, unnest([CASE WHEN {drawn} THEN length(x) ELSE 0 END for x in g]) AS counted,
               unnest([length(x) for x in s][1:len(m)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS s FROM d) WHERE len(m) > 0)""")
    needs = " OR ".join(f"(role = '{r}' AND {' AND '.join(f'has_{o}' for o in others)})" for r, others in NEEDS.items())
    has = ", ".join(f"bool_or(o.role = '{r}') AS has_{r}" for r in NEEDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(kinds)}),
every AS (SELECT doc_id, kind, place, role, end_ - len AS start, end_, strong FROM raw WHERE counted >= floor_),
c AS (SELECT * FROM (SELECT *, max(CASE WHEN kind <> 'bare' THEN end_ END) OVER (PARTITION BY doc_id ORDER BY start) AS reach FROM every) WHERE kind <> 'bare' OR reach IS NULL OR reach <= start),
w AS (
  SELECT a.doc_id, a.kind, a.place, a.role, a.start, a.end_, {has}
  FROM c a JOIN c o ON a.doc_id = o.doc_id AND NOT a.strong AND o.role <> 'none' AND o.role <> a.role AND abs(o.start - a.start) <= {SCOPE}
  GROUP BY ALL
),
spans AS (
  SELECT doc_id, kind, place, start, end_, TRUE AS strong FROM c WHERE strong
  UNION ALL SELECT doc_id, kind, place, start, end_, FALSE FROM w WHERE {needs}
),
per AS (
  SELECT doc_id, count(*) FILTER (strong AND kind = 'assign') AS n_assign, count(*) FILTER (strong AND kind = 'access') AS n_access,
         count(*) FILTER (strong AND kind = 'hex') AS n_hex, count(*) FILTER (NOT strong) AS n_linked,
         string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, place) FILTER (strong) AS base,
         string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, place, end_) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN per USING (doc_id)
"""


OP4_SQL = _sql()
