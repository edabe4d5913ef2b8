"""Text and path functions over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.functions import paths, text
from trovesift.plans.relations import ITEMS, items, table, with_

_EXCLUDED = "|".join(paths.glob_regex(g) for g in paths.EXCLUDED).replace("'", "''")
_KINDS = " ".join("WHEN extension IN ({}) THEN '{}'".format(", ".join(f"'{x}'" for x in names.split()), kind) for kind, names in paths.KINDS.items())

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'),
  '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '\A\s+|\s+\z', '', 'g')"""


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS clean_md5, length({_CLEAN.format('text')}) AS clean_chars FROM documents")
def text_clean(spark, sf_dir):
    cleaned = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("clean_md5"), F.length(cleaned).cast("long").alias("clean_chars"))


@query(f"SELECT page_id, md5({_CLEAN.format('html')}) AS clean_md5 FROM pages")
def html_raw_text(spark, sf_dir):
    """HTML is read as raw text, then cleaned."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean(F.col("html"))).alias("clean_md5"))


@query(with_(ITEMS) + "SELECT item_id, sha256(path || '#0') AS chunk_id FROM items")
def chunk_ids(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", text.chunk_id(F.col("path"), F.lit(0)).alias("chunk_id"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def content_hash_dedupe(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(with_(ITEMS) + f"SELECT extension, CASE {_KINDS} ELSE 'unknown' END AS kind, count(*) AS n FROM items GROUP BY ALL")
def kind_classify(spark, sf_dir):
    return items(spark, sf_dir).groupBy("extension", paths.kind_of(F.col("extension")).alias("kind")).agg(F.count("*").alias("n"))


@query(with_(ITEMS) + """SELECT item_id, path FROM items WHERE extension IN ('md', 'pdf') AND (path = '/home/u/Documents' OR path LIKE '/home/u/Documents/%')
  AND NOT (path LIKE '/home/u/Documents/src1/%') AND size BETWEEN 300 AND 5000 AND modified_at >= TIMESTAMP '2023-11-01'""")
def path_filter(spark, sf_dir):
    rule = paths.search_filter(["md", ".PDF"], ["/home/u/Documents"], ["/home/u/Documents/src1"], after=F.lit("2023-11-01").cast("timestamp"), least=300, most=5000)
    return items(spark, sf_dir).where(rule).select("item_id", "path")


@query(with_(ITEMS) + f"""SELECT item_id, CASE WHEN contains(path, '/src3/') OR regexp_matches(path, '{_EXCLUDED}') THEN 'exclude' WHEN contains(path, '.ssh/') THEN 'metadata_only'
  WHEN regexp_matches(path, '(?:^|/)\\.[^/]+/') THEN 'exclude' ELSE 'include' END AS verdict
  FROM (SELECT item_id, CASE item_id % 7 WHEN 0 THEN '/home/u/.ssh/' || name WHEN 1 THEN '/home/u/.config/' || name WHEN 2 THEN '/home/u/build/' || name ELSE path END AS path FROM items)""")
def path_validate(spark, sf_dir):
    k = F.col("item_id") % 7
    path = F.when(k == 0, F.concat(F.lit("/home/u/.ssh/"), "name")).when(k == 1, F.concat(F.lit("/home/u/.config/"), "name")).when(k == 2, F.concat(F.lit("/home/u/build/"), "name")).otherwise(F.col("path"))
    return items(spark, sf_dir).select("item_id", path.alias("path"), "size").select("item_id", paths.validate(F.col("path"), F.col("size"), ["src3/**"]).alias("verdict"))


@query(with_(ITEMS) + """SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'sensitive' WHEN item_id % 5 IN (1, 3) THEN 'hidden' ELSE 'normal' END AS sensitivity, item_id % 5 = 2 AS cloud_folder, item_id % 5 = 3 AS cloud_artifact FROM items""")
def sensitivity(spark, sf_dir):
    places = F.array(*map(F.lit, ("/h/.aws/", "/h/.local/x/", "/h/Dropbox/", "/h/a/.dropbox.cache/", "/h/plain/")))
    path = F.concat(F.element_at(places, (F.col("item_id") % 5 + 1).cast("int")), "name")
    p = items(spark, sf_dir).select("item_id", path.alias("path"))
    return p.select("item_id", paths.sensitivity(F.col("path")).alias("sensitivity"), paths.is_cloud_folder(F.col("path")).alias("cloud_folder"), paths.is_cloud_artifact(F.col("path")).alias("cloud_artifact"))


@query(with_(ITEMS) + "SELECT item_id, name FROM items WHERE contains(lower(name), 'doc') AND contains(lower(name), '12') ORDER BY length(name), name, item_id LIMIT 20")
def name_search(spark, sf_dir):
    from trovesift.operators.fulltext import name_search as search

    return search(items(spark, sf_dir), "Doc 12", 20).select("item_id", "name")


@query(r"""SELECT conv_id, turn, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '\A\s+|\s+\z', '', 'g'), '(?s)\A"(.*)"\z', '\1'), '[!?$@#%^&*(){}\[\]~`"'']', '', 'g'), '[–—]', '-', 'g'), '\s*-[\s\-]*', '-', 'g'), '\s+', ' ', 'g'), '\A\s+|\s+\z', '', 'g')) AS normalized FROM conversations""")
def query_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_query(F.col("text")).alias("normalized"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS n_distinct FROM documents")
def token_stats(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))
