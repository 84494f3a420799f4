"""Retrieval and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ann, chunking, ingest, vector, workflow
from ..operators.shared import saved, shared_path
from ..sources.tables import table
from .catalogue import query

_HITS = """
  with q as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 20 = 0),
  s as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], qe), 6) as score from embeddings, q where vec_id <> query_id),
  hits as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= {t} qualify rank <= {k})
"""


def _hits(spark, sf, k=5, threshold=0.1):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vector.top_k(v, v.filter("vec_id % 20 = 0"), k=k, threshold=threshold)


@query(_HITS.format(t=0.1, k=5) + "select query_id, vec_id, score, rank::int as rank from hits")
def vector_search_topk(spark, sf):
    """Top 5 by cosine over a threshold; queries: every row whose id is divisible by 20, against all rows."""
    return _hits(spark, sf).select("query_id", "vec_id", "score", "rank")


@query(_HITS.format(t=0.3, k=10) + "select query_id, count(*) as n, max(score) as best from hits group by query_id")
def vector_search_threshold(spark, sf):
    """How many of at most 10 hits pass the higher threshold of the client."""
    return _hits(spark, sf, 10, 0.3).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def _index(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return v, ann.CellIndex.build(v, shared_path(spark, "cell-index"), 64)


@query(_HITS.format(t=0.1, k=5) + "select query_id, vec_id, score, rank::int as rank from hits")
def vector_search_index(spark, sf):
    """The index of cells, all of them probed: the exact search's rows, so that no vector is lost in it."""
    v, index = _index(spark, sf)
    return index.search(v.filter("vec_id % 20 = 0"), k=5, threshold=0.1, nprobe=ann.CELLS).select("query_id", "vec_id", "score", "rank")


@query(_HITS.format(t=0.1, k=5) + "select count(*) as hits, true as enough from hits")
def vector_search_recall(spark, sf):
    """Whether three quarters of the cells hold nine tenths of the exact search's hits: these vectors point nearly at random, which is the hardest case."""
    v, index = _index(spark, sf)
    found = index.search(v.filter("vec_id % 20 = 0"), k=5, threshold=0.1, nprobe=-(-3 * len(index.at) // 4))
    return ann.recall(found, _hits(spark, sf)).select("hits", (F.col("recall") >= 0.9).alias("enough"))


_CONTEXT = _HITS.format(t=0.1, k=5) + """,
  chunks as (select doc_id as vec_id, doc_id, (doc_id % 8)::int as chunk_index, md5(text) as content from documents where source <> 'src3'),
  docs as (select doc_id, lang || '-' || source as doc_name, n_chars < 300 as deleted from documents)
"""


def _context(spark, sf, strict):
    d = table(spark, sf, "documents")
    chunks = d.filter("source <> 'src3'").select(F.col("doc_id").alias("vec_id"), "doc_id", (F.col("doc_id") % 8).cast("int").alias("chunk_index"), F.md5("text").alias("content"))
    docs = d.select("doc_id", F.concat_ws("-", "lang", "source").alias("doc_name"), (F.col("n_chars") < 300).alias("deleted"))
    return vector.with_context(_hits(spark, sf), chunks, docs, strict)


@query(_CONTEXT + "select query_id, rank::int as rank, vec_id, content, score, doc_id, doc_name, chunk_index from hits join chunks using (vec_id) left join docs using (doc_id)")
def search_with_context(spark, sf):
    """Hits with chunk and document; a missing chunk drops its hit after the top k, deleted documents still show."""
    return _context(spark, sf, False)


@query(_CONTEXT + "select query_id, rank::int as rank, vec_id, content, score, doc_id, doc_name, chunk_index from hits join chunks using (vec_id) join docs using (doc_id) where not deleted")
def search_with_context_strict(spark, sf):
    return _context(spark, sf, True)


@query(_CONTEXT + "select query_id, string_agg(content, chr(10) order by rank) as context from hits join chunks using (vec_id) left join docs using (doc_id) group by query_id")
def context_assembly(spark, sf):
    """Contents of a query's hits in the order of rank, one a line."""
    c = _context(spark, sf, False).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"))
    return c.select("query_id", F.array_join(F.transform("x", lambda x: x["content"]), "\n").alias("context"))


_MERGE = """list_reduce(list_prepend('', {p}), lambda acc, x: case when split_part(acc, chr(30), -1) = '' then acc || x
    when length(split_part(acc, chr(30), -1)) + length(x) + 1 <= 1024 then acc || {s} || x else acc || chr(30) || x end)"""
#: On these texts two separators matter: lines and spaces.
_CHUNKS = f"""
  with p as (select doc_id, unnest(string_split(text, chr(10))) as piece, generate_subscripts(string_split(text, chr(10)), 1) as i, instr(text, chr(10)) > 0 as many from documents),
  f as (select *, length(piece) >= 1024 or not many as big, sum((length(piece) >= 1024)::int) over (partition by doc_id order by i) as g from p),
  runs as (select doc_id, g, big, min(i) as i, list(piece order by i) as parts from f group by all),
  merged as (select doc_id, i, case when big then {_MERGE.format(p="string_split(parts[1], ' ')", s="' '")} else {_MERGE.format(p="parts", s="chr(10)")} end as m from runs),
  cut as (select doc_id, i, unnest(string_split(m, chr(30))) as c, generate_subscripts(string_split(m, chr(30)), 1) as j from merged),
  chunks as (select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int as chunk_index, trim(c, ' ' || chr(9) || chr(10) || chr(13)) as content from cut where trim(c, ' ' || chr(9) || chr(10) || chr(13)) <> '')
"""


@query(_CHUNKS + "select doc_id, chunk_index, length(content) as n_chars, md5(content) as digest from chunks")
def chunk_documents(spark, sf):
    """Recursive chunks of every text, with their place in it."""
    c = chunking.chunk_documents(table(spark, sf, "documents"))
    return c.select("doc_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query(_CHUNKS + "select doc_id, count(*) as n_chunks, max(length(content)) as longest from chunks group by doc_id")
def chunks_per_document(spark, sf):
    c = chunking.chunk_documents(table(spark, sf, "documents"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).cast("long").alias("longest"))


@query(_CHUNKS + """, h as (select doc_id, chunk_index, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_' || chunk_index)) as h from chunks)
  select doc_id, chunk_index, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||lower(printf('%02x', (('0x'||substr(h,17,2))::int & 63) | 128))||substr(h,19,2)||'-'||substr(h,21,12) as vector_id from h""")
def chunk_vector_ids(spark, sf):
    """Version 5 UUIDs of the chunks."""
    return chunking.chunk_documents(table(spark, sf, "documents")).select("doc_id", "chunk_index", "vector_id")


@query("select query_id, p.vec_id, label, n from (select vec_id as query_id, label from embeddings where vec_id % 20 = 0) q join (select label as l, max(vec_id) as vec_id, count(*) as n from embeddings group by label) p on label = l")
def collection_per_label(spark, sf):
    """A collection per knowledge base (label): its size and newest vector, for each query's base."""
    e = table(spark, sf, "embeddings")
    per = e.groupBy("label").agg(F.max("vec_id").alias("vec_id"), F.count("*").alias("n"))
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(per, "label").select("query_id", "vec_id", "label", "n")


@query("select doc_id, case when doc_id % 3 = 0 then 1024 else 0 end as size from documents")
def vector_size_by_model(spark, sf):
    """Vector size by a model's name, where it has a known one."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("BAAI/bge-m3")).alias("model"))
    return d.select("doc_id", F.when(F.col("model").isNotNull(), S.vector_size(F.col("model"))).otherwise(0).alias("size"))


def _embedded(name: str, key: str, source: str) -> str:
    """SQL of the hashing embedder over a table's text column x: 64 signed counts of hashed words, at length 1, as floats."""
    return f"""
  {name}_w as (select {key}, w, ('0x' || substr(md5(w), 1, 8))::bigint as h from (select {key}, unnest(regexp_extract_all(lower(x), '[^\\s\\x0B\\x1C-\\x1F]+')) as w from {source})),
  {name}_n as (select {key}, h % 64 as i, sum(case when h >= 2147483648 then 1 else -1 end) as n from {name}_w group by all),
  {name} as (select {key}, i, (n / sqrt(sum(n * n) over (partition by {key})))::float::double as a from {name}_n where n <> 0)"""


#: SQL up to the hits of each benchmark item in the base src1.
_FOUND = _CHUNKS + ", base as (select doc_id, chunk_index, content, content as x from chunks join documents using (doc_id) where source = 'src1'), asked as (select item_id, text as x from benchmark)," + _embedded("v", "doc_id, chunk_index", "base") + "," + _embedded("q", "item_id", "asked") + """,
  s as (select item_id, doc_id, chunk_index, round(sum(v.a * q.a) / any_value(nv) / any_value(nq), 6) as score
    from (select *, sqrt(sum(a * a) over (partition by doc_id, chunk_index)) as nv from v) v join (select *, sqrt(sum(a * a) over (partition by item_id)) as nq from q) q using (i) group by all),
  hits as (select *, row_number() over (partition by item_id order by score desc, doc_id * 1000 + chunk_index) as rank from s where score >= 0.3 qualify rank <= 5)"""


def _base(spark, sf):
    """What `vector.search` needs of the base src1: its vectors, chunks and documents."""
    d = table(spark, sf, "documents").filter("source = 'src1'").select("doc_id", "text", "lang", F.lit(None).cast("string").alias("error"))
    stored = saved(ingest.vectors(ingest.processed(d)).withColumn("vec_id", F.col("doc_id") * 1000 + F.col("chunk_index")), "base")
    documents = d.select("doc_id", F.col("lang").alias("doc_name"), F.lit(False).alias("deleted"))
    return stored.select("vec_id", "embedding"), stored.select("vec_id", "doc_id", "chunk_index", "content"), documents


@query(_FOUND + """
  select item_id as query_id, rank::int as rank, round(score, 4) as score, doc_id, lang as doc_name, chunk_index, md5(content) as digest from hits join base using (doc_id, chunk_index) join documents using (doc_id)""")
def knowledge_search(spark, sf):
    """Questions (the benchmark's) in one base: embedding, best chunks by cosine, their text and document."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = vector.search(*_base(spark, sf), asked, score_threshold=0.3)
    return found.select("query_id", "rank", F.round("score", 4).alias("score"), "doc_id", "doc_name", "chunk_index", F.md5("content").alias("digest"))


#: A workflow: start, a condition, then retrieval or a loop whose body adds to a variable, then the end.
_NODES = [("start", "start", None, None, None), ("ask", "condition", "go", "==", "0"), ("find", "knowledge", "context", None, "{{question}}"), ("again", "loop", None, None, "{{times}}"), ("add", "variable", "acc", None, "{{acc}}x"), ("end", "end", None, None, None)]
_EDGES = [("start", "ask", None), ("ask", "find", "true"), ("ask", "again", "false"), ("again", "add", "body"), ("add", "again", None), ("again", "end", "done"), ("find", "end", None)]


@query(_FOUND.replace("with", "with recursive", 1) + """,
  context as (select item_id, string_agg(content, chr(10) order by rank) as context from hits join base using (doc_id, chunk_index) group by item_id),
  t(run, node, acc, i, steps) as (
    select item_id, 'start', '', 0, 0 from benchmark union all
    select run, case node when 'start' then 'ask' when 'ask' then if(run % 3 = 0, 'find', 'again') when 'again' then if(i < run % 5, 'add', 'end') when 'add' then 'again' else 'end' end,
      if(node = 'add', acc || 'x', acc), if(node = 'again' and i < run % 5, i + 1, i), steps + 1 from t where node <> 'end')
  select run as run_id, acc, if(run % 3 = 0, md5(coalesce(context, '')), '') as context, steps::int as steps, 'success' as status from t left join context on item_id = run and run % 3 = 0 where node = 'end'""")
def workflow_runs(spark, sf):
    """Documented only: a workflow with a branch, a loop and retrieval, over all its runs at once (a run per benchmark item)."""
    b = table(spark, sf, "benchmark")
    given = F.create_map(F.lit("question"), F.col("text"), F.lit("go"), (F.col("item_id") % 3).cast("string"), F.lit("times"), (F.col("item_id") % 5).cast("string"))
    nodes, edges = spark.createDataFrame(_NODES, "id string, kind string, name string, test string, value string"), spark.createDataFrame(_EDGES, "src string, dst string, handle string")
    base = _base(spark, sf)

    def retrieve(questions):
        hits = vector.search(*base, questions, score_threshold=0.3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"))
        return hits.select("query_id", F.array_join(F.transform("x", lambda x: x["content"]), "\n").alias("context"))

    done = workflow.executed(b.select(F.col("item_id").alias("run_id"), given.alias("vars")), nodes, edges, retrieve)
    var = lambda k: F.element_at("vars", k)
    return done.select("run_id", F.coalesce(var("acc"), F.lit("")).alias("acc"), F.coalesce(F.md5(var("context")), F.lit("")).alias("context"), "steps", "status")
