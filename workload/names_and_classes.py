"""Names, class lists, coverage and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import names as N
from boxloom.operators import coverage as C
from boxloom.operators import labels as L
from boxloom.operators import registry as R
from boxloom.sinks import tables as S
from boxloom.sources import catalog, images
from boxloom.sources.class_lists import class_entries
from boxloom.sources.training_logs import setting_rows
from workload import views as V
from workload.register import query
from workload.views import with_views

_CANON = V._CANON
_SUFFIX = "'^(.*)_([A-Z]{2,5}\\p{Nd}{1,5})$', '\\1'"


# --- sources -------------------------------------------------------------------------------

@query(with_views("printings", "SELECT card_no, name, pos, id, set_id, image_url FROM printings"))
def printings_flat(spark, d):
    return catalog.printings(V.catalog(spark, d))


@query(with_views("parsed", "SELECT split, stem, box_no, class_id, cx, cy, w, h FROM parsed"))
def label_scan(spark, d):
    return L.parse_lines(V.label_lines(spark, d), "skip_line")


@query(with_views("parsed tokens", """
SELECT p.* FROM parsed p LEFT JOIN (
  SELECT split, stem, min(line_no) AS stop FROM tokens
  WHERE len(t) = 5 AND try_cast(t[1] AS bigint) IS NULL GROUP BY ALL) s USING (split, stem)
WHERE s.stop IS NULL OR box_no < s.stop"""))
def label_scan_until_bad_line(spark, d):
    return L.parse_lines(V.label_lines(spark, d), "abort_file")


@query(with_views("tokens", """
SELECT split, stem, line_no AS box_no, cast(replace(t[1], 'x', '69') AS bigint) AS class_id
FROM tokens WHERE len(t) > 0"""))
def label_scan_any_length(spark, d):
    """The lax scan, which fails on a bad class; bad ones are mended first."""
    lines = V.label_lines(spark, d).withColumn("line", F.regexp_replace("line", "^x", "69"))
    return L.parse_lines(lines, "failfast").select("split", "stem", "box_no", "class_id")


@query(with_views("image_paths", """
SELECT split_part(path, '/', 2) AS split, regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', '') AS stem,
       split_part(path, '/', 4) AS file
FROM image_paths WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg)$')"""))
def image_inventory(spark, d):
    return images.split_images(V.image_paths(spark, d))


@query(with_views("named_files", f"SELECT DISTINCT {_CANON} AS name FROM named_files WHERE set_code IN ('SEA', 'HVY')"))
def discovered_classes(spark, d):
    files = images.set_images(V.card_files(spark, d))
    return R.discovered_classes(files, ["SEA", "HVY"])


@query(with_views("known_registry", "SELECT class_id, name FROM known_registry"))
def clean_class_list(spark, d):
    return R.clean_class_list(V.known_classes(spark, d))


@query(with_views("known_registry known_classes", f"""
SELECT pos AS old_id, class_id FROM known_classes k JOIN known_registry r ON r.name = {_CANON}"""))
def class_id_map(spark, d):
    raw = V.known_classes(spark, d)
    return R.id_map(raw, R.clean_class_list(raw))


@query(with_views("known_registry", "SELECT class_id, name FROM known_registry"))
def imported_class_list(spark, d):
    """A stored list (one row, an array of names) taken apart and cleaned."""
    raw = V.known_classes(spark, d)
    stored = raw.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "raw_name"))), lambda c: c["raw_name"]).alias("names"))
    return R.clean_class_list(class_entries(stored))


@query(with_views("registry label_counts", """
SELECT r.class_id, r.name, s.split,
       coalesce(CASE WHEN r.class_id % 5 = 0 THEN NULL ELSE v.n END, 0) AS n
FROM registry r CROSS JOIN (VALUES ('train'), ('valid'), ('test'), ('total')) s(split)
LEFT JOIN label_counts v ON v.class_id = r.class_id AND v.split = s.split"""))
def stored_coverage(spark, d):
    """Stored counts as text; every fifth class holds no whole number."""
    registry = V.registry(spark, d)
    counted = C.label_counts(V.labels(spark, d)).join(registry, "class_id")
    text = F.when(F.col("class_id") % 5 == 0, F.concat(F.col("n").cast("string"), F.lit("?"))).otherwise(
        F.col("n").cast("string"))
    stored = counted.select("name", "split", text.alias("n"))
    return C.stored_coverage(registry, stored)


@query("""
SELECT 'run' || cast(o_custkey % 7 AS varchar) AS run, 'key_' || cast(o_orderkey AS varchar) AS key,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS value
FROM orders WHERE o_orderkey % 11 <> 0""")
def run_settings(spark, d):
    c = F.col
    lines = V.table(spark, d, "orders").select(
        F.concat(F.lit("run"), (c("o_custkey") % 7).cast("string")).alias("run"),
        F.concat(F.when(c("o_orderkey") % 11 == 0, "  ").otherwise(""), F.lit("key_"),
                 c("o_orderkey").cast("string"), F.lit(": "),
                 F.when(c("o_orderkey") % 5 == 0, "null").otherwise(c("o_orderpriority"))).alias("line"))
    return setting_rows(lines)


# --- names ---------------------------------------------------------------------------------

@query(with_views("cards", f"""
SELECT card_no, {_CANON} AS name, regexp_replace(raw_name || '-CF', {_SUFFIX}) AS kept,
       regexp_replace('A_' || raw_name || '_AB1', {_SUFFIX}) AS once,
       set_code || '/' || {_CANON} AS by_set FROM cards"""))
def canonical_names(spark, d):
    raw = F.col("raw_name")
    return V.cards(spark, d).select(
        "card_no", N.canonical_name(raw).alias("name"),
        N.canonical_name(F.concat(raw, F.lit("-CF"))).alias("kept"),
        N.canonical_name(F.concat(F.lit("A_"), raw, F.lit("_AB1"))).alias("once"),
        N.canonical_name(raw, keep_printings=True).alias("by_set"))


@query(with_views("printings", """
SELECT card_no, pos, regexp_replace(replace(coalesce(CASE WHEN card_no % 17 = 0 THEN NULL ELSE name || '''s (v.2)' END, 'unknown'),
       ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') || '_' || id || '.png' AS file FROM printings"""))
def image_file_names(spark, d):
    rows = catalog.printings(V.catalog(spark, d))
    name = F.when(F.col("card_no") % 17 != 0, F.concat("name", F.lit("'s (v.2)")))
    return rows.select("card_no", "pos", N.image_file_name(name, F.col("id")).alias("file"))


@query(with_views("cards", """
SELECT card_no, lower(trim(shown)) AS exact, regexp_replace(lower(trim(shown)), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS loose,
       lower(trim(replace(asked, '_', ' '))) AS search,
       regexp_replace(lower(trim(replace(asked, '_', ' '))), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS search_loose
FROM (SELECT card_no, '  ' || upper(name) || ', Éclair & Co! ' AS shown, replace(name, ' ', '_') || '_Æther-7' AS asked FROM cards)"""))
def lookup_keys(spark, d):
    shown = F.concat(F.lit("  "), F.upper("name"), F.lit(", Éclair & Co! "))
    asked = F.concat(F.translate("name", " ", "_"), F.lit("_Æther-7"))
    exact, search = N.exact_key(shown), N.search_key(asked)
    return V.cards(spark, d).select(
        "card_no", exact.alias("exact"), N.loose_key(exact).alias("loose"),
        search.alias("search"), N.loose_key(search).alias("search_loose"))


@query(with_views("images", """
SELECT img, 'synthetic_' || cast(img AS varchar) || '_' || substr(md5('s1|' || cast(img AS varchar)), 1, 8) || '_' || stem AS out_stem
FROM images"""))
def output_stems(spark, d):
    return V.images(spark, d).select(
        "img", N.output_stem("s1", F.col("img"), F.col("stem")).alias("out_stem"))


# --- registries ----------------------------------------------------------------------------

@query(with_views("registry known_registry", """
SELECT r.class_id, r.name, k.name IS NULL AS added FROM registry r LEFT JOIN known_registry k USING (name)"""))
def extended_registry(spark, d):
    known = R.clean_class_list(V.known_classes(spark, d))
    found = R.in_discovery_order(V.cards(spark, d).select(F.col("card_no").alias("pos"), "raw_name"))
    return R.extend_registry(known, found)


@query(with_views("known_registry named_files", f"""
SELECT row_number() OVER (ORDER BY s, p) - 1 AS class_id, name FROM (
  SELECT name, 0 AS s, cast(class_id AS varchar) AS k, class_id AS p FROM known_registry
  UNION ALL
  SELECT name, 1, name, row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT {_CANON} AS name FROM named_files)
  WHERE name NOT IN (SELECT name FROM known_registry))"""))
def merged_class_list(spark, d):
    known = R.clean_class_list(V.known_classes(spark, d)).withColumnRenamed("class_id", "pos")
    files = images.set_images(V.card_files(spark, d))
    found = R.in_name_order(R.discovered_classes(files, list(V.SETS)))
    return R.merged_class_list(known, found)


@query(with_views("known_registry cards", f"""
SELECT DISTINCT {_CANON} AS name FROM cards WHERE {_CANON} NOT IN (SELECT name FROM known_registry)"""))
def unregistered_names(spark, d):
    known = R.clean_class_list(V.known_classes(spark, d))
    return R.names_not_in(
        V.cards(spark, d).select(N.canonical_name(F.col("raw_name")).alias("name")), known)


@query(with_views("cards", """
SELECT DISTINCT raw_name AS name FROM cards WHERE raw_name NOT IN (SELECT raw_name FROM cards WHERE card_no % 5 <> 0)"""))
def unregistered_printings(spark, d):
    """Full card names that an older registry, of four cards in five, does not hold; grows with the cards."""
    cards = V.cards(spark, d).select("card_no", F.col("raw_name").alias("name"))
    return R.names_not_in(cards.select("name"), cards.filter(F.col("card_no") % 5 != 0).select("name"))


@query(with_views("registry", """
SELECT pos, name, max(a) AS in_registry, max(b) AS in_manifest, max(c) AS in_coverage FROM (
  SELECT class_id AS pos, name, 1 AS a, 0 AS b, 0 AS c FROM registry
  UNION ALL SELECT class_id, CASE WHEN class_id % 9 = 4 THEN upper(name) ELSE name END, 0, 1, 0 FROM registry
  UNION ALL SELECT class_id, name, 0, 0, 1 FROM registry WHERE class_id % 10 <> 3)
GROUP BY pos, name HAVING max(a) + max(b) + max(c) < 3"""))
def class_list_differences(spark, d):
    """Three lists: one with changed names, one with missing ones."""
    registry = V.registry(spark, d).withColumnRenamed("class_id", "pos")
    changed = registry.withColumn(
        "name", F.when(F.col("pos") % 9 == 4, F.upper("name")).otherwise(F.col("name")))
    return R.list_differences({
        "registry": registry, "manifest": changed, "coverage": registry.filter(F.col("pos") % 10 != 3)})


@query(with_views("registry", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM registry"))
def sorted_names(spark, d):
    return R.in_name_order(V.registry(spark, d)).orderBy("name")


@query(with_views("registry cards", f"""
SELECT card_no, r.name, class_id FROM (SELECT card_no, {_CANON} AS name FROM cards) c JOIN registry r USING (name)"""))
def class_ids_by_name(spark, d):
    named = V.cards(spark, d).select("card_no", N.canonical_name(F.col("raw_name")).alias("name"))
    return R.with_class_ids(named, V.registry(spark, d))


@query(with_views("boxes registry", """
SELECT img, box, cls % 80 AS class_id,
       coalesce(CASE WHEN r.class_id < 10 THEN 'own ' || r.name END, r.name, cast(cls % 80 AS varchar)) AS label
FROM boxes LEFT JOIN registry r ON r.class_id = cls % 80"""))
def class_labels(spark, d):
    """Names of the result come before names of the model; unknown ids stay as text."""
    registry = V.registry(spark, d)
    own = registry.filter(F.col("class_id") < 10).withColumn("name", F.concat(F.lit("own "), "name"))
    rows = V.boxes(spark, d).select("img", "box", (F.col("cls") % 80).alias("class_id"))
    return R.with_class_labels(rows, registry, own)


# --- labels against the registry -------------------------------------------------------------

@query(with_views("labels registry", "SELECT split, stem, box_no, class_id FROM labels WHERE class_id IN (SELECT class_id FROM registry)"))
def known_class_labels(spark, d):
    return L.known_classes_only(V.labels(spark, d), V.registry(spark, d)).select(
        "split", "stem", "box_no", "class_id")


@query(with_views("labels registry", """
SELECT class_id, count(*) AS n FROM labels WHERE class_id NOT IN (SELECT class_id FROM registry) GROUP BY 1"""))
def unknown_class_ids(spark, d):
    return L.unknown_class_ids(V.labels(spark, d), V.registry(spark, d))


@query(with_views("truth", "SELECT cls AS class_id, count(*) AS n FROM truth GROUP BY 1"))
def accepted_class_ids(spark, d):
    """The strict check, on labels that pass it."""
    sound = V.truth(spark, d).withColumnRenamed("cls", "class_id")
    return L.reject_unknown_classes(sound, V.registry(spark, d))


@query(with_views("labels known_registry known_classes", f"""
SELECT stem, box_no, r.class_id FROM labels l JOIN known_classes k ON k.pos = l.class_id
JOIN known_registry r ON r.name = {_CANON}"""))
def renumbered_labels(spark, d):
    raw = V.known_classes(spark, d)
    ids = R.id_map(raw, R.clean_class_list(raw))
    return L.renumber(V.labels(spark, d), ids).select("stem", "box_no", "class_id")


def _coverage(spark, d):
    return C.coverage(V.registry(spark, d), C.label_counts(V.labels(spark, d)))


@query(with_views("coverage", "SELECT class_id, name, split, n FROM coverage"))
def class_coverage(spark, d):
    return _coverage(spark, d)


_TOTALS = """
SELECT class_id, name, cast(sum(n) FILTER (split = 'train') AS bigint) AS train, cast(sum(n) FILTER (split = 'valid') AS bigint) AS valid,
       cast(sum(n) FILTER (split = 'test') AS bigint) AS test, cast(sum(n) AS bigint) AS total FROM coverage GROUP BY 1, 2"""


@query(with_views("coverage", """
SELECT class_id, name, split, n FROM coverage UNION ALL
SELECT class_id, name, 'total', cast(sum(n) AS bigint) FROM coverage GROUP BY 1, 2"""))
def coverage_totals(spark, d):
    return C.coverage_long_with_totals(_coverage(spark, d))


@query(with_views("coverage", _TOTALS))
def coverage_table(spark, d):
    return S.coverage_table(_coverage(spark, d))


@query(with_views("registry truth", f"""
SELECT split, count(*) FILTER (n = 0) AS missing FROM (
  SELECT r.class_id, s.split, count(t.cls) AS n FROM registry r
  CROSS JOIN (VALUES ('train'), ('valid'), ('test'), ('total')) s(split)
  LEFT JOIN (SELECT cls, {V._SPLIT} AS split FROM truth) t
    ON t.cls = r.class_id AND (t.split = s.split OR s.split = 'total') GROUP BY ALL) GROUP BY 1"""))
def missing_classes(spark, d):
    """Registered classes that the truth boxes lack."""
    labels = V.truth(spark, d).select(
        V.split_of(F.col("img")).alias("split"), F.col("cls").alias("class_id"))
    return C.missing_classes(C.coverage(V.registry(spark, d), C.label_counts(labels)))


@query(with_views("images label_lines", """
SELECT split, files, labels FROM (SELECT split, count(*) AS files FROM images GROUP BY 1)
LEFT JOIN (SELECT split, count(*) AS labels FROM label_lines GROUP BY 1) USING (split)"""))
def split_stats(spark, d):
    return C.split_stats(V.images(spark, d), V.label_lines(spark, d))


@query(with_views("parsed", "SELECT count(DISTINCT class_id) AS n_ids, min(class_id) AS min_id, max(class_id) AS max_id FROM parsed"))
def used_id_range(spark, d):
    return C.used_id_range(L.parse_lines(V.label_lines(spark, d)))


@query(with_views("image_paths", """
SELECT s.split, count(path) AS n FROM (VALUES ('train'), ('valid'), ('test')) s(split)
LEFT JOIN (SELECT * FROM image_paths WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg)$')) i
ON split_part(path, '/', 2) = s.split GROUP BY 1"""))
def images_per_split(spark, d):
    return C.images_per_split(images.split_images(V.image_paths(spark, d)))


def _used(spark, d):
    return V.truth(spark, d).select(F.col("cls").alias("class_id")).distinct()


_USED = "(SELECT DISTINCT cls FROM truth)"


@query(with_views("registry truth", f"SELECT class_id, name FROM registry WHERE class_id IN {_USED}"))
def used_classes(spark, d):
    return R.used_classes(V.registry(spark, d), _used(spark, d))


@query(with_views("registry truth", f"SELECT class_id, name FROM registry WHERE class_id NOT IN {_USED}"))
def unused_classes(spark, d):
    return R.unused_classes(V.registry(spark, d), _used(spark, d))


@query(with_views("registry truth", f"""
SELECT status, class_id, name, count(*) OVER () AS total, count(*) FILTER (status = 'used') OVER () AS n_used,
       count(*) FILTER (status = 'unused') OVER () AS n_unused
FROM (SELECT *, CASE WHEN class_id IN {_USED} THEN 'used' ELSE 'unused' END AS status FROM registry)"""))
def class_usage_report(spark, d):
    return S.usage_report(R.class_usage(V.registry(spark, d), _used(spark, d)))


@query(with_views("registry", """
SELECT 'C:/data/set/train/images' AS train, 'C:/data/set/valid/images' AS val, 'C:/data/set/test/images' AS test,
       cast(count(*) AS int) AS nc, list(name ORDER BY class_id) AS names FROM registry"""))
def dataset_manifest(spark, d):
    return S.manifest(V.registry(spark, d), "C:\\data\\set")
