"""The question loop as set-oriented stages: route, gate, rewrite, retrieve, answer, grade, retry, links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import rewrite_gate, rewrite_or_original, strip, word_count
from lodeworks.operators.retrieval import source_links
from lodeworks.operators.shared import written

MAX_ITERATIONS = 2
#: Messages of a history that reach the model.
HISTORY = 4
DIRECT_PROMPT = "You are a helpful assistant. Answer greetings and thanks in a short and friendly way."
CONTEXT_PROMPT = "Answer from the context alone. Say so if the answer is not in it."
NO_INFORMATION = "No information on this was found."
DIRECT_REPLY = "Hello, how can I help you?"
GREETINGS = ["hello", "hi", "thanks", "thank you", "bye", "merhaba", "selam", "teşekkürler"]
QUESTION_WORDS = r"\b(what|who|when|where|why|how|which)\b"


def route(question: Column) -> Column:
    """`direct` for short greetings and thanks without a question word, else `rag`."""
    q = F.lower(strip(question))
    greets = F.lit(False)
    for g in GREETINGS:
        greets = greets | q.startswith(g)
    return F.when(greets & ~q.rlike(QUESTION_WORDS) & (word_count(question) <= 4), "direct").otherwise("rag")


def grade(reply: Column, compat_substring: bool = False) -> Column:
    """useful or not_useful from a judge's reply. The compat form takes any reply that contains `useful`."""
    r = F.lower(strip(reply))
    return F.when(r.contains("useful") if compat_substring else r == "useful", "useful").otherwise("not_useful")


def decide(verdict: Column, iterations: Column) -> Column:
    return F.when((verdict == "useful") | (iterations >= MAX_ITERATIONS), "end").otherwise("retry")


def _words(x: Column) -> Column:
    return F.array_remove(F.split(F.lower(x), r"[^\p{L}0-9]+"), "")


def overlap_grade(question: Column, answer: Column) -> Column:
    """The stand-in judge: an answer that isn't empty or the fixed phrase and shares a word with the question."""
    some = (F.length(strip(F.coalesce(answer, F.lit("")))) > 0) & (answer != NO_INFORMATION)
    return F.when(some & F.arrays_overlap(_words(question), _words(answer)), "useful").otherwise("not_useful")


def _sentences(question: Column, text: Column) -> Column:
    """struct<n, at, sentence> of each sentence: the question's words in it, and its place counted backwards."""
    asked = _words(question)
    each = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.length(strip(x)) > 0)
    return F.transform(each, lambda x, i: F.struct(F.size(F.array_intersect(asked, _words(x))).alias("n"), (-i).alias("at"), strip(x).alias("sentence")))


def best_overlap(question: Column, text: Column) -> Column:
    """The most words that one sentence shares with the question: the stand-in for a re-ranker's score."""
    return F.array_max(_sentences(question, text))["n"]


def best_sentence(question: Column, context: Column) -> Column:
    """The sentence of the numbered context that shares most words with the question, the first of equal ones."""
    return F.array_max(_sentences(question, F.regexp_replace(context, r"(?m)^\[\d+\] ", "")))["sentence"]


def searched(questions: DataFrame, hyde: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds `search`, the text to retrieve by. Where the gate passes, the last user message goes before the question.

    A history is in `history_size` and `previous`, the last user message; hyde may turn the text into a made-up answer.
    """
    search = F.col("question")
    if {"history_size", "previous"} <= set(questions.columns):
        both = F.concat_ws(" ", "previous", "question")
        search = F.when(rewrite_gate(search, F.col("history_size")), rewrite_or_original(both, search)).otherwise(search)
    return questions.withColumn("search", hyde(search) if hyde else search)


def messages(questions: DataFrame) -> Column:
    """What a text model is asked, array<struct<role, content>>: the route's instruction, the last HISTORY messages of the
    question's `history` if there is one, and the question, with its context where the route has one."""
    row = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.when(F.col("route") == "direct", DIRECT_PROMPT).otherwise(CONTEXT_PROMPT)
    user = F.when(F.col("context").isNull(), F.col("question")).otherwise(F.concat(F.lit("CONTEXT:\n"), "context", F.lit("\n\nQUESTION: "), "question"))
    parts = [F.array(row("system", system)), F.array(row("user", user))]
    if "history" in questions.columns:
        said = F.filter(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["content"].isNotNull())
        parts.insert(1, F.slice(said, F.greatest(F.size(said) - (HISTORY - 1), F.lit(1)), F.lit(HISTORY)))
    return F.concat(*parts)


def prompt(said: Column) -> Column:
    """Messages as one text for a model that takes prompts."""
    return F.array_join(F.transform(said, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n")


def answer(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], hyde: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions: question_id, question and perhaps a history (see searched and messages). retrieve adds `context` and perhaps
    `links` by the column `search`; generate adds `answer` to rows with question, context and `messages`, on both routes; a direct question without one gets a fixed reply, and
    the first admissible links follow an answer from a context.

    Each pass works only on rows that still need one; a direct route ends after its pass. With functions
    that give the same result twice, a retry changes nothing, so at most MAX_ITERATIONS passes are planned. A pass is
    written to the shared folder, as both its ends and its retries read it.
    """
    todo = searched(questions, hyde).withColumn("route", route(F.col("question")))
    direct = todo.filter("route = 'direct'").withColumn("context", F.lit(None).cast("string"))
    done = generate(direct.withColumn("messages", messages(direct))).withColumn("answer", F.coalesce("answer", F.lit(DIRECT_REPLY))).withColumn("iterations", F.lit(1)).withColumn("grade", overlap_grade(F.col("question"), F.col("answer")))
    left = todo.filter("route = 'rag'")
    for n in range(1, MAX_ITERATIONS + 1):
        found = retrieve(left)
        tried = generate(found.withColumn("messages", messages(found))).withColumn("iterations", F.lit(n))
        tried = tried.withColumn("answer", F.when(F.col("context").isNull(), NO_INFORMATION).otherwise(F.col("answer"))).withColumn("grade", overlap_grade(F.col("question"), F.col("answer")))
        if "links" in tried.columns:
            links = source_links(F.col("links"))
            tried = tried.withColumn("answer", F.when(F.col("context").isNotNull() & (F.size(links) > 0), F.concat_ws("\n", "answer", F.array_join(links, "\n"))).otherwise(F.col("answer")))
        tried = written(tried)
        end = decide(F.col("grade"), F.col("iterations"))
        done = done.unionByName(tried.filter(end == "end"), allowMissingColumns=True)
        left = tried.filter(end == "retry").select(*questions.columns, "search", "route")
    return done
