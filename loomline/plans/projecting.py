"""Projections and scalar rules over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators.ranges import in_order
from ..registry import query

_CODE = "'=' || lpad((p_partkey % 200)::VARCHAR, 3, '0') || '.' || chr(65 + (p_partkey % 26)::INT)"


def coded(t):
    letter = F.chr((F.col("p_partkey") % 26 + 65).cast("int"))
    return t.part.withColumn("code", F.concat(F.lit("="), F.lpad((F.col("p_partkey") % 200).cast("string"), 3, "0"), F.lit("."), letter))


@query(
    "p2_json_rendering",
    "SELECT vec_id, CASE WHEN label >= 0 THEN '{\"label\":' || label || '}' END AS point FROM embeddings",
)
def p2(t):
    return t.embeddings.select("vec_id", F.when(F.col("label") >= 0, F.to_json(F.struct("label"))).alias("point"))


@query("p4_json_projection", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events")
def p4(t):
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("v")).where(F.lit(True))


@query("p7_page_labels", f"SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(substr({_CODE}, 2)) ELSE upper(substr({_CODE}, 2)) || '/' || p_size END AS label FROM part")
def p7(t):
    page = F.when(F.col("p_size") <= 40, F.col("p_size"))
    return coded(t).select("p_partkey", sc.drawing_label(sc.function_code(F.col("code")), page).alias("label"))


@query(
    "p10_evidence_rows",
    """SELECT o_orderkey, l_suppkey AS page, CASE WHEN l_suppkey = o_custkey THEN 'source' WHEN l_linenumber = 1 THEN 'target' ELSE 'other' END AS kind
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""",
)
def p10(t):
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_suppkey")).alias("p"))
    rows = t.orders.where("o_orderstatus = 'P'").join(pages, "o_orderkey").select("o_orderkey", "o_custkey", F.inline("p"))
    kind = F.when(F.col("l_suppkey") == F.col("o_custkey"), "source").when(F.col("l_linenumber") == 1, "target").otherwise("other")
    return rows.select("o_orderkey", F.col("l_suppkey").alias("page"), kind.alias("kind"))


@query("p11_public_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def p11(t):
    return t.customer.drop("c_nationkey", "c_acctbal")


@query(
    "p12_p14_leaf_paths",
    """SELECT l_orderkey, 'lines[' || (rn - 1) || '].' || f AS path, CASE f WHEN 'part' THEN l_partkey ELSE l_suppkey END::VARCHAR AS value
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, unnest(['part', 'supp']) AS f FROM lineitem)""",
)
def p14(t):
    return leaf_paths(t.lineitem)


#: Keys that a comparison ignores, at any depth.
IGNORED = ("line",)


def leaf_paths(lines, ignored=IGNORED):
    """Nested rows as (path, value) of their leaves, without the paths that go through an ignored key."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    flat = nested.select("l_orderkey", F.posexplode("lines").alias("i", "x"))
    leaf = lambda f: F.struct(F.format_string(f"lines[%d].{f}", "i").alias("path"), F.col(f"x.{f}").cast("string").alias("value"))
    leaves = flat.select("l_orderkey", F.inline(F.array(leaf("line"), leaf("part"), leaf("supp"))))
    keys = F.transform(F.split("path", "[.]"), lambda k: F.regexp_replace(k, r"\[\d+\]$", ""))
    return leaves.where(~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ignored]))) if ignored else leaves


@query(
    "p16_evidence_path",
    """SELECT o_orderkey, concat_ws(' > ', CASE WHEN o_orderstatus <> 'O' THEN 'status ' || o_orderstatus END, CASE WHEN o_totalprice > 150000 THEN 'large' END,
              'priority ' || left(o_orderpriority, 1)) AS path FROM orders""",
)
def p16(t):
    facts = F.array_compact(
        F.array(
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("status "), "o_orderstatus")),
            F.when(F.col("o_totalprice") > 150000, F.lit("large")),
            F.concat(F.lit("priority "), F.substring("o_orderpriority", 1, 1)),
        )
    )
    return t.orders.select("o_orderkey", F.array_join(facts, " > ").alias("path"))


@query(
    "p17_changed_fields",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus IS DISTINCT FROM nullif('F', 'X') THEN 'status' END, CASE WHEN nullif(o_custkey % 3, 0) IS DISTINCT FROM 1 THEN 'owner' END) AS changed FROM orders""",
)
def p17(t):
    pairs = {"status": (F.col("o_orderstatus"), F.lit("F")), "owner": (F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.lit(1))}
    return t.orders.select("o_orderkey", F.array_join(sc.changed_fields(pairs), ",").alias("changed"))


@query(
    "p18_overlay_projection",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN nullif(o_orderpriority, '1-URGENT') ELSE o_orderstatus END AS v FROM orders",
)
def p18(t):
    """Where the correction has the field its value wins, a null too."""
    has, new = F.col("o_orderkey") % 3 == 0, F.nullif("o_orderpriority", F.lit("1-URGENT"))
    return t.orders.select("o_orderkey", F.when(has, new).otherwise(F.col("o_orderstatus")).alias("v"))


@query("p23_flatten_groups", "SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem")
def p23(t):
    """Groups flattened in order of their id."""
    return in_order(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "place")


@query(
    "x1_x2_codes",
    f"SELECT p_partkey, upper(substr({_CODE}, 2)) AS code, regexp_replace(upper(substr({_CODE}, 2)) || '-' || replace(p_type, ' ', '-'), '[^A-Z0-9._-]+', '-', 'g') AS slug FROM part",
)
def x1(t):
    rows = coded(t)
    slug = sc.folder_slug(F.concat(F.lit("="), "code", F.lit(" "), "p_type"))
    return rows.select("p_partkey", sc.function_code(F.col("code")).alias("code"), slug.alias("slug"))


@query(
    "x5_sheet_codec",
    """SELECT p_partkey, 'GCR.' || (p_partkey % 99 + 1) AS function, (p_partkey % 26 + 1)::INT AS number, (p_partkey % 99 + 1) || chr((p_partkey % 26 + 65)::INT) AS sheet FROM part""",
)
def x5(t):
    """A sheet such as 3C as (GCR.3, 3), and back."""
    from ..functions.dialects import decode_sheet, encode_sheet

    sheet = F.concat((F.col("p_partkey") % 99 + 1).cast("string"), F.chr((F.col("p_partkey") % 26 + 65).cast("int")))
    coded = t.part.select("p_partkey", encode_sheet(sheet).alias("s"))
    return coded.select("p_partkey", "s.function", "s.number", decode_sheet(F.col("s.function"), F.col("s.number")).alias("sheet"))


@query("x20_crop_transform", "SELECT vec_id, round(0.25 + embedding[1]::DOUBLE * 0.5, 9) AS x, round(embedding[1]::DOUBLE, 6) AS back FROM embeddings")
def x20(t):
    at = F.col("embedding")[0].cast("double")
    page = sc.crop_to_page(at, F.lit(0.25), F.lit(0.5))
    return t.embeddings.select("vec_id", F.round(page, 9).alias("x"), F.round(sc.page_to_crop(page, F.lit(0.25), F.lit(0.5)), 6).alias("back"))


@query(
    "x22_uuid5",
    """SELECT n_nationkey, lower(left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id
       FROM (SELECT n_nationkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('nation:' || n_name)) AS h FROM nation)""",
)
def x22(t):
    return t.nation.select("n_nationkey", sc.uuid5(F.concat(F.lit("nation:"), "n_name")).alias("id"))


@query(
    "x23_digests",
    "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS h FROM nation",
)
def x23(t):
    return t.nation.select("n_nationkey", F.md5("n_name").alias("m"), F.sha1("n_name").alias("s"), F.sha2("n_name", 256).alias("h"))


@query("x24_name_keys", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k FROM supplier")
def x24(t):
    return t.supplier.select("s_suppkey", sc.name_key(F.col("s_name")).alias("k"))


@query("x25_file_names", "SELECT event_id, regexp_replace(trim(props), '[\\\\/:*?\"<>|]+', '_', 'g') AS f FROM events")
def x25(t):
    return file_names(t.events)


def file_names(events):
    return events.select("event_id", sc.file_name(F.col("props")).alias("f"))


@query("x27_clamp", "SELECT event_id, greatest(0.0, least(1.0, value / 60 - 0.3))::DOUBLE AS c FROM events")
def x27(t):
    return t.events.select("event_id", sc.clamp01(F.col("value") / 60 - 0.3).alias("c"))


@query("x28_object_editing", "SELECT event_id, event_type || ':' || 'set' AS edited, value > 50 AS has FROM events")
def x28(t):
    m = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.when(F.col("value") > 50, F.create_map(F.lit("v"), F.lit("1"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return t.events.select("event_id", F.concat_ws(":", m["type"], F.lit("set")).alias("edited"), F.map_contains_key(m, "v").alias("has"))


@query("x29_full_matches", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]+')")
def x29(t):
    return full_matches(t.part)


def full_matches(part):
    return part.where(F.col("p_brand").rlike("^Brand#[0-9]+$")).select("p_partkey")


@query("x30_null_discipline", "SELECT doc_id, nullif(trim(left(source, 3)), 'src') IS NULL AS gone FROM documents")
def x30(t):
    return t.documents.select("doc_id", F.nullif(sc.blank_to_null(F.substring("source", 1, 3)), F.lit("src")).isNull().alias("gone"))


@query("x31_lease", "SELECT o_orderkey, o_orderdate + INTERVAL 120 SECOND < TIMESTAMP '1997-01-01' AS expired FROM orders")
def x31(t):
    return t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 120 seconds") < F.to_timestamp(F.lit("1997-01-01"))).alias("expired"))


@query(
    "x32_signatures",
    """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || coalesce(nullif(s_nationkey, 3)::VARCHAR, 'null') || '}') AS signature FROM supplier""",
)
def x32(t):
    """Digest of an endpoint's fields, nulls kept, coordinates left out."""
    return t.supplier.select("s_suppkey", sc.row_digest(F.col("s_name"), F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey")).alias("signature"))
