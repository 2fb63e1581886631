from pyspark.sql import functions as F

from lodeworks.operators import agent
from lodeworks.plans import catalogue


def test_answer_is_the_best_sentence_and_direct_has_a_template(spark, tmp_path):
    docs = [(i, f"alpha beta filler{i}. Nothing here.") for i in range(5)] + [(9, "Some words first. The alpha beta gamma is open at nine. alpha.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "when is alpha beta open"), (2, "hello")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r["question_id"]: r for r in catalogue.agent_answers(spark, str(tmp_path)).collect()}
    assert rows[1]["answer"] == "The alpha beta gamma is open at nine." and rows[1]["grade"] == "useful"
    assert rows[2]["route"] == "direct" and rows[2]["answer"] == agent.DIRECT_REPLY


def test_history_hyde_and_links(spark):
    q = spark.createDataFrame([(1, "and the fees?", 2, "tell me of the library"), (2, "who leads it?", 0, None)], "question_id long, question string, history_size int, previous string")
    retrieve = lambda x: x.withColumn("context", F.col("search")).withColumn("links", F.array(F.lit("ftp://x"), F.lit("http://a"), F.lit("http://a"), F.lit("http://b")))
    rows = {r["question_id"]: r for r in agent.answer(q, retrieve, lambda x: x.withColumn("answer", F.col("context")), hyde=F.upper).collect()}
    assert rows[1]["answer"] == "TELL ME OF THE LIBRARY AND THE FEES?\nhttp://a\nhttp://b"
    assert rows[2]["answer"].startswith("WHO LEADS IT?")


def test_messages_hold_the_last_of_the_history_on_both_routes(spark):
    said = [(f"{'user' if i % 2 == 0 else 'assistant'}", f"m{i}") for i in range(7)]
    q = spark.createDataFrame([(1, "hello", said), (2, "who leads the library?", said), (3, "what is open?", None)], "question_id long, question string, history array<struct<role:string,content:string>>")
    seen = []

    def generate(x):
        seen.append(x.columns)
        return x.withColumn("answer", agent.prompt(F.col("messages")))

    retrieve = lambda x: x.withColumn("context", F.lit("[1] the library is led by Ada"))
    rows = {r["question_id"]: r["answer"] for r in agent.answer(q, retrieve, generate).collect()}
    assert all("messages" in c for c in seen)
    assert rows[1] == f"SYSTEM: {agent.DIRECT_PROMPT}\n\nASSISTANT: m3\n\nUSER: m4\n\nASSISTANT: m5\n\nUSER: m6\n\nUSER: hello"
    assert rows[2].startswith(f"SYSTEM: {agent.CONTEXT_PROMPT}\n\nASSISTANT: m3\n\n") and rows[2].endswith("USER: CONTEXT:\n[1] the library is led by Ada\n\nQUESTION: who leads the library?")
    assert rows[3].count("\n\n") == 2 and "m6" not in rows[3]
