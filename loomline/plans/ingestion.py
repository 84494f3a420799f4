"""Ingestion and upload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import parsers
from ..sources.tables import table
from .catalogue import query
from .search import _CHUNKS

_BAD = "n_chars < 50"


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    text = F.when(F.col("n_chars") < 20, F.lit(" \n\t")).otherwise(F.col("text"))
    return d.withColumn("text", text).withColumn("error", F.when(F.expr(_BAD) & (F.col("n_chars") >= 20), F.lit("UnicodeDecodeError")))


@query(_CHUNKS + f"""select doc_id, case when {_BAD} then 'failed' else 'completed' end as status, case when n_chars < 20 then 'document is empty' when {_BAD} then 'UnicodeDecodeError' else '' end as message,
  case when {_BAD} then 0 else coalesce(n, 0) end as chunk_count from documents left join (select doc_id, count(*) as n from chunks group by doc_id) using (doc_id)""")
def ingest_documents(spark, sf):
    """Parse, chunk and count with a status for each document; a failed one has a message and no chunks."""
    p = ingest.processed(_docs(spark, sf))
    return p.select("doc_id", "status", F.coalesce("error_message", F.lit("")).alias("message"), F.col("chunk_count").cast("long").alias("chunk_count"))


@query(_CHUNKS + f"select doc_id, count(*) as vectors, 64::bigint as dim from chunks join documents using (doc_id) where not ({_BAD}) group by doc_id")
def ingest_vectors(spark, sf):
    """Vectors of each completed document, one a chunk, of one size."""
    v = ingest.vectors(ingest.processed(_docs(spark, sf)))
    return v.groupBy("doc_id").agg(F.count_distinct("vector_id").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"))


_NAME = "case doc_id % 5 when 0 then 'A.b.TXT' when 1 then 'x.md' when 2 then 'noext' when 3 then 'virus.exe' else 'y.pdf' end"


@query(f"""with f as (select doc_id, {_NAME} as name, case when n_chars % 7 = 0 then 0 else n_chars end as size from documents),
  e as (select *, case when instr(name, '.') > 0 then lower(string_split(name, '.')[-1]) else '' end as ext from f)
  select doc_id, ext, case when ext not in ('txt', 'md', 'pdf', 'docx') then 'unsupported type: ' || ext when size <= 0 then 'empty file' else '' end as error from e""")
def upload_validation(spark, sf):
    """Extensions of uploads, and why some are refused."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "A.b.TXT").when(k == 1, "x.md").when(k == 2, "noext").when(k == 3, "virus.exe").otherwise("y.pdf")
    size = F.when(F.col("n_chars") % 7 == 0, 0).otherwise(F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", parsers.extension(name).alias("ext"), F.coalesce(parsers.upload_error(name, size), F.lit("")).alias("error"))


@query("select page_id, md5(html) as digest, '' as error from pages")
def parse_pages(spark, sf):
    """Bytes to text through the parsers, as Markdown keeps its markup."""
    p = table(spark, sf, "pages").select("page_id", parsers.parsed(F.encode("html", "UTF-8"), F.lit("md")).alias("p"))
    return p.select("page_id", F.md5("p.text").alias("digest"), F.coalesce("p.error", F.lit("")).alias("error"))


@query("""with b as (select doc_id as id, length(source)::bigint as tenant_id, case doc_id % 5 when 0 then '  ' when 1 then ' base ' || doc_id || ' ' else source end as name, case doc_id % 3 when 0 then null when 1 then 'BGE-large' else 'text-embedding-3-small' end as model from documents),
  e as (select *, case when trim(name) = '' then 'name is empty' when model = 'text-embedding-3-small' then 'unknown embedding model: ' || model else '' end as error from b)
  select id, tenant_id, trim(name) as name, coalesce(model, 'BAAI/bge-m3') as embedding_model, error, 0 as document_count, 0::bigint as chunk_count, if(error = '', 'kb_' || id, '') as collection, if(error = '', 1024, 0)::int as size from e""")
def new_knowledge_bases(spark, sf):
    """Bases as they are created, with the collection of each; what is refused says why."""
    k, m = F.col("doc_id") % 5, F.col("doc_id") % 3
    name = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" base "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise(F.col("source"))
    model = F.when(m == 1, "BGE-large").when(m == 2, "text-embedding-3-small")
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("source").cast("long").alias("tenant_id"), name.alias("name"), F.lit(None).cast("string").alias("description"), model.alias("embedding_model"))
    made = ingest.new_bases(asked).drop("description")
    return made.withColumns({"error": F.coalesce("error", F.lit("")), "collection": F.coalesce("collection", F.lit("")), "size": F.coalesce("size", F.lit(0))})


@query("select source as kb, doc_id, row_number() over (partition by source order by doc_id desc) as place from documents qualify place between 11 and 20")
def document_pages(spark, sf):
    """The second page of every base's documents, newest first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return table(spark, sf, "documents").select(F.col("source").alias("kb"), "doc_id", place.cast("long").alias("place")).filter("place between 11 and 20")


@query(_CHUNKS + f"""select source as kb, count(*) as document_count, coalesce(sum(case when {_BAD} then 0 else n end), 0)::bigint as chunk_count
  from documents left join (select doc_id, count(*) as n from chunks group by doc_id) using (doc_id) group by source""")
def knowledge_base_counters(spark, sf):
    """Documents (failed ones too) and the chunks of completed ones per base, counted anew instead of kept."""
    p = ingest.processed(_docs(spark, sf))
    return p.groupBy(F.col("source").alias("kb")).agg(F.count("*").alias("document_count"), F.sum("chunk_count").cast("long").alias("chunk_count"))


@query(_CHUNKS + f"""select doc_id, case when {_BAD} or doc_id % 9 = 0 then 'failed' else 'completed' end as status,
  case when n_chars < 20 then 'document is empty' when {_BAD} then 'UnicodeDecodeError' when doc_id % 9 = 0 then (n - 1) || ' vectors for ' || n || ' chunks' else '' end as message
  from documents left join (select doc_id, count(*) as n from chunks group by doc_id) using (doc_id)""")
def vectors_per_chunk(spark, sf):
    """Documents whose vectors aren't as many as their chunks fail: here every ninth document loses one."""
    p = ingest.processed(_docs(spark, sf))
    stored = p.filter("status = 'completed'").select("doc_id", F.posexplode("chunks").alias("i", "c")).filter("doc_id % 9 <> 0 or i > 0")
    return ingest.verified(p, stored).select("doc_id", "status", F.coalesce("error_message", F.lit("")).alias("message"))


@query(f"""select doc_id, step::int as step, case step when 1 then 'pending' when 2 then 'processing' else case when {_BAD} then 'failed' else 'completed' end end as status from documents, range(1, 4) t(step)""")
def document_states(spark, sf):
    """The states of every document in order."""
    return ingest.states(_docs(spark, sf)).select("doc_id", "step", "status")
