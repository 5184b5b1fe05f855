"""Queries of operators that SQL cannot express; tested against brute force and round trips."""

from pyspark.sql import functions as F

from quern.operators import syntax
from quern.operators.durable import durable
from quern.operators.embed import embed_documents
from quern.plans.session_queries import STREAM, session_log
from quern.queries import query, table


def _parsed(spark, sf, other: str):
    """Every file of code_chunks, put together and parsed once, without the rows of a kind that the query does not use."""
    return durable(syntax.parse_files(syntax.whole_files(table(spark, sf, "code_chunks"))).filter(F.col("kind") != other))


@query()
def ast_chunks(spark, sf):
    return syntax.chunk_files(_parsed(spark, sf, "edge")).select("id", "file_path", "start_line", "end_line", "name", "node_type", "signature", "language")


@query()
def ast_edges(spark, sf):
    return syntax.raw_edges(_parsed(spark, sf, "fallback"))


@query()
def embed_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return embed_documents(d).select("doc_id", "token_count", "embed_ok", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(STREAM)
def stream_sessions(spark, sf):
    """The session stream over all events, run to its end; the last state of every session."""
    import uuid

    from quern.operators.folders import Folder, shared_folder
    from quern.streaming.sessions import session_stream

    work = f"{shared_folder(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    session_log(spark, sf).write.parquet(f"{work}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{work}/in").schema).parquet(f"{work}/in")
    out = session_stream(events, ttl_s=None).writeStream.foreachBatch(lambda b, n: b.write.parquet(f"{work}/out/{n}")).outputMode("update")
    out.option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.option("recursiveFileLookup", "true").parquet(f"{work}/out")
    last = F.max(F.struct("last_seq", "visited_count", "frontier_count", "log_count", "annotation_count"))
    result = durable(done.groupBy("session_id").agg(last.alias("s")).select("session_id", "s.*"))
    Folder(spark, work).delete()
    return result
