"""Readers of the retrieval benchmarks' JSON shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rankers import turn_text

TURN = "struct<role:string,content:string>"
LONGMEM = (
    f"question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, "
    f"haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>"
)
LOCOMO_QA = "array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"
CONVOMEM = "conversations array<struct<messages:array<struct<speaker:string,text:string>>>>, question string, message_evidences array<struct<text:string>>"
MEMBENCH_TURN = "struct<sid:string,mid:string,user:string,user_message:string,assistant:string,assistant_message:string,time:string>"
MEMBENCH_QA = "struct<question:string,choices:map<string,string>,ground_truth:string,answer:string,target_step_id:array<array<int>>>"


def longmem_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LONGMEM).option("multiLine", "true").json(path)


def longmem_sessions(questions: DataFrame) -> DataFrame:
    """(question_id, session_id, date, pos, text, is_answer): one document for each session of a haystack, the user's turns only."""
    z = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    e = questions.select("question_id", "answer_session_ids", F.posexplode(z).alias("pos", "s"))
    user = F.filter("s.turns", lambda t: t["role"] == "user")
    text = F.array_join(F.transform(user, lambda t: t["content"]), "\n")
    return e.select("question_id", F.col("s.id").alias("session_id"), F.col("s.date").alias("date"), "pos", text.alias("text"), F.array_contains("answer_session_ids", F.col("s.id")).alias("is_answer"))


def locomo_sessions(conversations: DataFrame) -> DataFrame:
    """(conv_id, session, date, dialogs) from rows (conv_id, conversation as JSON) whose keys are session_N and session_N_date_time."""
    m = F.from_json("conversation", "map<string,string>")
    e = conversations.select("conv_id", m.alias("m"), F.explode(F.map_keys(m)).alias("k")).where(F.col("k").rlike(r"^session_\d+$"))
    dialogs = F.from_json(F.col("m")[F.col("k")], "array<struct<speaker:string,dia_id:string,text:string>>")
    return e.select("conv_id", F.regexp_extract("k", r"(\d+)", 1).cast("int").alias("session"), F.col("m")[F.concat("k", F.lit("_date_time"))].alias("date"), dialogs.alias("dialogs"))


def locomo_documents(sessions: DataFrame, by_dialog: bool = False) -> DataFrame:
    """One document for each session, or each dialog."""
    line = lambda d: F.concat(d["speaker"], F.lit(": "), d["text"])
    if by_dialog:
        return sessions.select("conv_id", F.explode("dialogs").alias("d")).select("conv_id", F.col("d.dia_id").alias("id"), line(F.col("d")).alias("text"))
    return sessions.select("conv_id", F.concat(F.lit("D"), "session").alias("id"), F.array_join(F.transform("dialogs", line), "\n").alias("text"))


def evidence_sessions(evidence) -> F.Column:
    """Session ids D<n> of evidence such as D3:7."""
    return F.array_distinct(F.transform(evidence, lambda x: F.regexp_extract(x, r"^(D\d+)", 1)))


def convomem_messages(items: DataFrame) -> DataFrame:
    """(item_id, pos, text) of all messages."""
    m = F.flatten(F.transform("conversations", lambda c: c["messages"]))
    return items.select("item_id", F.posexplode(m).alias("pos", "m")).select("item_id", "pos", F.col("m.text").alias("text"))


def membench_turns(items: DataFrame, nested: bool = True) -> DataFrame:
    """(tid, sid, global_id, text) of flat or nested lists of turns."""
    turns = F.flatten("message_list") if nested else F.col("message_list")
    e = items.select("tid", F.posexplode(turns).alias("global_id", "t"))
    text = turn_text(F.col("t.time"), F.coalesce("t.user", "t.user_message"), F.coalesce("t.assistant", "t.assistant_message"))
    return e.select("tid", F.coalesce("t.sid", "t.mid").alias("sid"), "global_id", text.alias("text"))
