"""Registered queries: each operator over the given tables, with the SQL it must equal."""

from pyspark.sql import functions as F

from ..functions import chat, labels
from ..functions.chat_templates import ChatTemplate
from ..functions.rounding import exact_sql
from ..functions.text import truncated
from ..operators import class_lists, classifier, metrics, overlap, runs, subwords, timings
from ..operators.convert import to_messages
from ..operators.limits import head_n, head_n_per_task
from ..operators.score import WAVES, label_responses, respond, score_examples
from ..operators.summary import run_summary
from ..plans.evaluation import evaluate, evaluate_counts, evaluate_scored, evaluate_stored
from ..session import new_folder
from ..sinks import evaluations, registry, report
from ..sinks.chat_lines import write_chats
from ..sinks.training_text import training_text, write_training_text
from ..sources import files
from ..sources.specs import shipped_specs, spec_frame, task_specs
from ..sources.turns import (
    answer_places_from_turns, answers_from_turns, label_chats, messages_from_turns, prepare_turns, prompts_from_turns,
)
from . import sql
from .predictors import keyword_predictor

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = ["THAT", "WITH", "ICH"]
WORD_ORDER = ["THAT", "WITH", "ICH"]

# ---- chats stored by turn ------------------------------------------------------


@query("""
WITH ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(turn // 4096 AS BIGINT) AS part, bool_or(turn = last_turn) AS is_last, count(*) AS n_turns,
  string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars
FROM conversations JOIN ends USING (conv_id) GROUP BY conv_id, turn // 4096""")
def chat_messages(spark, sf_dir):
    chats = messages_from_turns(table(spark, sf_dir, "conversations"))
    return chats.select(
        "conv_id", "part", "is_last", F.size("messages").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.aggregate("messages", F.lit(0).cast("bigint"), lambda n, m: n + F.length(m["content"])).alias("chars"),
    )


@query("""
SELECT conv_id, count(*) AS n_turns, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS expected
FROM conversations GROUP BY conv_id""")
def chat_answers(spark, sf_dir):
    return answers_from_turns(table(spark, sf_dir, "conversations"))


@query("""
SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS expected,
  count(*) - 1 AS n_prompt,
  coalesce(max(turn) FILTER (WHERE role = 'assistant'), max(turn) + 1) - min(turn) AS n_before_answer
FROM conversations GROUP BY conv_id""")
def last_assistant(spark, sf_dir):
    return answer_places_from_turns(table(spark, sf_dir, "conversations"))


@query(f"""
SELECT conv_id, CAST(turn // 4096 AS BIGINT) AS part, string_agg({sql.turn()}, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, turn // 4096""")
def chat_text(spark, sf_dir):
    chats = messages_from_turns(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "part", chat.render_chat("messages").alias("text"))


PROMPT_PIECES = f"""
WITH ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
pieces AS (
  SELECT conv_id, turn,
    CASE WHEN turn = last_turn THEN '<|im_start|>assistant' || chr(10) ELSE {sql.turn()} END AS piece
  FROM conversations JOIN ends USING (conv_id))"""


@query(PROMPT_PIECES + """
SELECT conv_id, CAST(turn // 4096 AS BIGINT) AS part, string_agg(piece, chr(10) ORDER BY turn) AS prompt
FROM pieces GROUP BY conv_id, turn // 4096""")
def prompt_text(spark, sf_dir):
    chats = messages_from_turns(table(spark, sf_dir, "conversations"))
    asked, whole = chat.prompt_sql(chat.asked_sql("messages")), chat.chat_sql("messages")
    return chats.selectExpr("conv_id", "part", f"if(is_last, {asked}, {whole}) AS prompt")


@query(PROMPT_PIECES + f""",
whole AS (SELECT conv_id, string_agg(piece, chr(10) ORDER BY turn) AS prompt FROM pieces GROUP BY conv_id)
SELECT conv_id, {sql.first_tokens('prompt', 60)[1]} AS prompt FROM whole""")
def prompt_capped(spark, sf_dir):
    return prompts_from_turns(table(spark, sf_dir, "conversations"), max_tokens=60)


#: Fixed value: the shape of a published template, with a mark for each role and the end of a turn.
ROLE_TEMPLATE = ChatTemplate(
    "{% for message in messages %}{% if message['role'] == 'user' %}{{ '<|user|>\n' + message['content'] + eos_token }}"
    "{% elif message['role'] == 'system' %}{{ '<|system|>\n' + message['content'] + eos_token }}"
    "{% else %}{{ '<|assistant|>\n' + message['content'] | trim + eos_token }}{% endif %}"
    "{% if loop.last and add_generation_prompt %}{{ '<|assistant|>' }}{% endif %}{% endfor %}",
    {"eos_token": "</s>\n"},
)


@query("""
WITH ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(turn // 4096 AS BIGINT) AS part, string_agg(
  CASE role WHEN 'user' THEN '<|user|>' || chr(10) || text WHEN 'system' THEN '<|system|>' || chr(10) || text
    ELSE '<|assistant|>' || chr(10) || regexp_replace(text, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') END || '</s>' || chr(10), '' ORDER BY turn)
  || '<|assistant|>' AS prompt
FROM conversations JOIN ends USING (conv_id) GROUP BY conv_id, turn // 4096""")
def template_prompts(spark, sf_dir):
    """Prompts by a model's own template, compiled to an expression."""
    chats = messages_from_turns(table(spark, sf_dir, "conversations"))
    return chats.selectExpr("conv_id", "part", f"{ROLE_TEMPLATE.prompt_sql('messages')} AS prompt")


def halves(spark, sf_dir):
    """Documents as a training and a test set by a hash of the id; exact copies fall into both."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"), (F.expr("conv(substring(md5(CAST(doc_id AS STRING)), 1, 4), 16, 10)").cast("int") % 4 == 0).alias("is_test"))
    return docs.where("NOT is_test"), docs.where("is_test")


@query("""
WITH split AS (SELECT text, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[:4] AS BIGINT) % 4 = 0 AS is_test FROM documents WHERE text IS NOT NULL),
per AS (SELECT text, count(*) FILTER (WHERE NOT is_test) AS a, count(*) FILTER (WHERE is_test) AS b FROM split GROUP BY text)
SELECT count(*) AS n_prompts, CAST(coalesce(sum(a), 0) AS BIGINT) AS n_train, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_test FROM per WHERE a > 0 AND b > 0""")
def split_overlap(spark, sf_dir):
    """How many prompts a training and a test split share."""
    return overlap.overlap(*halves(spark, sf_dir))


CHAT_LABELS = PROMPT_PIECES + f""",
whole AS (SELECT conv_id, string_agg(piece, chr(10) ORDER BY turn) AS prompt FROM pieces GROUP BY conv_id),
truth AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id),
named AS (
  SELECT conv_id, CASE WHEN answer <> '' THEN {sql.label('answer', WORDS, WORD_ORDER)} END AS expected,
    CASE WHEN answer <> '' THEN {sql.label('prompt', WORDS, WORD_ORDER)} END AS predicted
  FROM whole JOIN truth USING (conv_id))"""


@query(CHAT_LABELS + " SELECT * FROM named")
def chat_labels(spark, sf_dir):
    return label_chats(table(spark, sf_dir, "conversations"), WORDS)


@query(CHAT_LABELS + " SELECT expected, predicted, count(*) AS n FROM named GROUP BY expected, predicted")
def chat_label_confusion(spark, sf_dir):
    """The flagship: turns to confusion counts, skipped chats included."""
    chats = label_chats(table(spark, sf_dir, "conversations"), WORDS)
    return metrics.confusion(chats.withColumn("task", F.lit("words"))).drop("task")


# ---- layout conversion ---------------------------------------------------------

# Prompts and answers that results must equal.
HELPER = "'You are a helpful assistant.'"
CVE_TEXT = (
    "'You are a cybersecurity expert specializing in CVE analysis. Given a CVE description, provide the "
    "severity level (CRITICAL, HIGH, MEDIUM, LOW) and a brief risk summary.'"
)
UNRATED = "'MEDIUM. Requires further analysis.'"


def flat(df, key):
    """Key and the three contents of converted rows."""
    parts = [F.col("messages")[i]["content"].alias(n) for i, n in enumerate(["system", "user", "assistant"])]
    return df.select(key, *parts)


@query(f"""
SELECT p_partkey, {CVE_TEXT} AS "system",
  'Analyze this CVE:' || chr(10) || chr(10) || 'CVE ID: CVE-' || p_partkey || chr(10) || 'Description: ' || p_name AS "user",
  CASE WHEN p_size % 5 IN (0, 1) THEN {UNRATED} ELSE p_type END AS assistant
FROM part""")
def convert_cve(spark, sf_dir):
    size = F.col("p_size") % 5
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("CVE-"), "p_partkey").alias("cve_id"), F.col("p_name").alias("description"),
        F.when(size == 0, None).when(size == 1, "").otherwise(F.col("p_type")).alias("severity"),
    )
    return flat(to_messages(rows), "p_partkey")


@query(f"""
SELECT l_orderkey * 10 + l_linenumber AS line, {CVE_TEXT} AS "system",
  'Analyze this CVE:' || chr(10) || chr(10) || 'CVE ID: Unknown' || chr(10) || 'Description: ' ||
    CASE WHEN l_returnflag = 'R' THEN 'None' ELSE l_returnflag END AS "user",
  CASE WHEN l_discount = 0 THEN {UNRATED} ELSE CAST(l_discount AS VARCHAR) END AS assistant
FROM lineitem""")
def convert_cve_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.nullif("l_returnflag", F.lit("R")).alias("description"), F.col("l_discount").alias("severity"),
    )
    return flat(to_messages(rows), "line")


@query(f"""
SELECT doc_id, {HELPER} AS "system",
  'Name the language' || CASE WHEN lang = 'de' OR text = '' THEN '' ELSE chr(10) || chr(10) || text END AS "user",
  coalesce(nullif(lang, 'fr'), 'None') AS assistant
FROM documents""")
def convert_instruction(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("Name the language").alias("instruction"),
        F.when(F.col("lang") != "de", F.col("text")).alias("input"), F.nullif("lang", F.lit("fr")).alias("output"),
    )
    return flat(to_messages(rows), "doc_id")


@query(f"SELECT item_id, {HELPER} AS \"system\", text AS \"user\", CAST(item_id AS VARCHAR) AS assistant FROM benchmark")
def convert_qa(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.col("item_id").alias("answer"))
    return flat(to_messages(rows), "item_id")


@query(f"SELECT page_id, {HELPER} AS \"system\", url AS \"user\", html AS assistant FROM pages")
def convert_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("prompt"), F.col("html").alias("completion"))
    return flat(to_messages(rows), "page_id")


def mixed_json(spark, sf_dir):
    """One JSON text per row, of six layouts, from five tables."""
    def rows(kind, key, name, value):
        return table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), value.alias("raw"))

    def js(**fields):
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))

    size = F.col("p_size")
    parts = [
        rows("cve", "p_partkey", "part", F.when(size % 3 == 0, js(cve_id=F.col("p_partkey"), text=F.col("p_name"), label=size % 2))
             .when(size % 3 == 1, js(description=F.col("p_name"), severity=size > 25, question=F.lit("q"), answer=F.lit("a")))
             .otherwise(F.concat(F.lit('{"cve_id": null, "description": null, "severity": '), F.col("p_retailprice").cast("decimal(10,1)").cast("string"), F.lit("}")))),
        rows("instruction", "doc_id", "documents", F.when(F.col("lang") == "en", js(instruction=F.lit("Name it"), input=F.col("text"), output=F.col("lang")))
             .otherwise(js(instruction=F.lit("Name it"), question=F.col("source"), answer=F.col("n_chars")))),
        rows("qa", "item_id", "benchmark", js(question=F.col("text"), answer=F.col("item_id") % 2 == 0)),
        rows("prompt", "page_id", "pages", js(prompt=F.col("url"), completion=F.col("html"))),
        rows("unknown", "event_id", "events", js(text=F.col("event_type"), severity=F.col("value"))),
        table(spark, sf_dir, "conversations").select(
            F.lit("messages").alias("kind"), (F.col("conv_id") * 1000000 + F.col("turn")).alias("id"),
            F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct("role", F.col("text").alias("content")))))
            .otherwise(js(messages=F.array(F.struct("role", F.col("text").alias("content"))), prompt=F.lit("p"), completion=F.lit("c"))).alias("raw"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""
SELECT 'cve' AS kind, p_partkey AS id, CAST(3 AS BIGINT) AS n,
  'Analyze this CVE:' || chr(10) || chr(10) || 'CVE ID: ' ||
    CASE p_size % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'Unknown' ELSE 'None' END ||
    chr(10) || 'Description: ' || CASE p_size % 3 WHEN 2 THEN 'None' ELSE p_name END AS before_last,
  CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'MEDIUM. Requires further analysis.' ELSE '1' END
    WHEN 1 THEN CASE WHEN p_size > 25 THEN 'True' ELSE 'MEDIUM. Requires further analysis.' END
    ELSE CAST(CAST(p_retailprice AS DECIMAL(10,1)) AS VARCHAR) END AS last
FROM part
UNION ALL
SELECT 'instruction', doc_id, 3,
  CASE WHEN lang = 'en' THEN 'Name it' || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || text END ELSE source END,
  CASE WHEN lang = 'en' THEN lang ELSE CAST(n_chars AS VARCHAR) END FROM documents
UNION ALL
SELECT 'qa', item_id, 3, text, CASE WHEN item_id % 2 = 0 THEN 'True' ELSE 'False' END FROM benchmark
UNION ALL
SELECT 'prompt', page_id, 3, url, html FROM pages
UNION ALL
SELECT 'messages', conv_id * 1000000 + turn, 1, NULL, text FROM conversations""")
def convert_mixed(spark, sf_dir):
    rows = to_messages(mixed_json(spark, sf_dir))
    return rows.select(
        "kind", "id", F.size("messages").cast("bigint").alias("n"),
        F.try_element_at("messages", F.when(F.size("messages") > 1, -2).otherwise(99))["content"].alias("before_last"),
        F.element_at("messages", -1)["content"].alias("last"),
    )


# ---- labels, truncation, limits ------------------------------------------------


@query(f"SELECT doc_id, {sql.label('text', WORDS, WORD_ORDER)} AS label FROM documents")
def extract_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.extract_label("text", WORDS).alias("label"))


@query(f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {sql.label('text', ['THE', 'WITH', 'AND'], ['WITH', 'THE', 'AND'])}
  ELSE {sql.label('text', ['ICH', 'UND', 'NICHT', 'LES'], ['NICHT', 'ICH', 'UND', 'LES'])} END AS label
FROM documents""")
def extract_label_by_row(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "if(lang = 'en', array('the', 'with', 'and'), array('ich', 'und', 'nicht', 'les')) AS classes")
    return rows.select("doc_id", labels.extract_label_by_row("text", "classes").alias("label"))


@query(r"""
WITH words AS (
  -- the other engine writes the capital of one German letter as two
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_]+'))) AS word FROM documents),
named AS (
  SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM words WHERE regexp_full_match(word, '[A-Z]{4,}')
  GROUP BY word ORDER BY place LIMIT 10000),
found AS (SELECT doc_id, arg_min(word, (-length(word), place)) AS label FROM words JOIN named USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(label, (SELECT word FROM named WHERE place = 1)) END AS label
FROM documents LEFT JOIN found USING (doc_id)""")
def extract_label_long_list(spark, sf_dir):
    """Labels from a list of ten thousand classes: the commonest words of the documents."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(upper(text), '[\\p{L}\\p{N}_]+', 0)"))).alias("word"))
    common = words.where(F.col("word").rlike("^[A-Z]{4,}$")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(10_000)
    names = [r["word"] for r in common.collect()]  # the class list, at most ten thousand names
    return class_lists.with_label(docs.select("doc_id", "text"), "text", names).select("doc_id", "label")


@query(f"SELECT doc_id, {sql.first_tokens('text', 50)[1]} AS text, {sql.first_tokens('text', 50)[0]} AS truncated FROM documents")
def truncated_text(spark, sf_dir):
    return truncated(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 50, flag="truncated")


#: A published vocabulary's rank file; a parameter of the queries below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query(sql.subword_counts("documents", "doc_id", VOCABULARY, 128))
def subword_counts(spark, sf_dir, vocabulary=VOCABULARY):
    """Sub-word tokens of whole texts, and how much of each a cap of 128 keeps."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    known = subwords.Vocabulary(spark, vocabulary)
    counted = subwords.with_token_count(rows, "text", known)
    cut = subwords.token_capped(counted, "text", 128, known, flag="truncated", size="kept_bytes")
    return cut.select("doc_id", "n_tokens", "truncated", "kept_bytes")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 500")
def head_rows(spark, sf_dir):
    return head_n(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 500, "event_id")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 50000")
def head_rows_many(spark, sf_dir):
    return head_n(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), 50_000, "event_id")


EVENT_CAPS = {"click": 500, "error": 40, "purchase": 1000}


@query("""
WITH ranked AS (SELECT event_type AS task, event_id AS seq, value,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
SELECT task, seq, value FROM ranked
WHERE rn <= CASE task WHEN 'click' THEN 500 WHEN 'error' THEN 40 WHEN 'purchase' THEN 1000 ELSE rn END""")
def head_rows_per_task(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("seq"), "value")
    return head_n_per_task(rows, EVENT_CAPS, keep_others=True)


@query("SELECT doc_id, lang, length(text) AS chars FROM documents ORDER BY doc_id LIMIT 150")
def head_of_file(spark, sf_dir):
    rows = files.read_head(spark, f"{sf_dir}/documents.parquet", "parquet", 150)
    return rows.select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"))


# ---- evaluation ----------------------------------------------------------------

EVENT_CLASSES = ["CLICK", "VIEW", "PURCHASE", "SIGNUP", "ERROR", "NEVER"]
EVENT_TASK = [("events", "multiclass", 0.2, EVENT_CLASSES)]


def event_specs():
    return task_specs([{"task": "events", "task_type": "multiclass", "classes": EVENT_CLASSES, "quality_gate": 0.2}])


def scored_events(spark, sf_dir, *kept):
    guess = F.get_json_object("props", "$.k").cast("int") % 5
    names = F.array(*map(F.lit, EVENT_CLASSES))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("task"), F.upper("event_type").alias("expected"), F.element_at(names, guess + 1).alias("predicted"), *kept
    )


SCORED_EVENTS = (
    "SELECT 'events' AS task, upper(event_type) AS expected, "
    "['CLICK', 'VIEW', 'PURCHASE', 'SIGNUP', 'ERROR'][CAST(props->>'$.k' AS INT) % 5 + 1] AS predicted FROM events"
)

DOC_TASK = [("quality", "binary", 0.8, ["GOOD", "BAD"])]


def quality_specs(gate=0.8):
    return task_specs([{"task": "quality", "classes": ["good", "bad"], "quality_gate": gate, "max_test_samples": None}])


def scored_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(known, "doc_id").select(
        F.lit("quality").alias("task"), F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("expected"),
        F.when(F.col("n_chars") >= 300, "GOOD").otherwise("BAD").alias("predicted"),
    )


SCORED_DOCUMENTS = (
    "SELECT 'quality' AS task, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS expected, "
    "CASE WHEN n_chars >= 300 THEN 'GOOD' ELSE 'BAD' END AS predicted FROM documents JOIN labels USING (doc_id)"
)


@query(f"SELECT expected, predicted, count(*) AS n FROM ({SCORED_EVENTS}) GROUP BY expected, predicted")
def confusion(spark, sf_dir):
    return metrics.confusion(scored_events(spark, sf_dir)).drop("task")


@query(f"SELECT expected, " + ", ".join(
    f"count(*) FILTER (WHERE predicted = '{c}') AS \"{c}\"" for c in EVENT_CLASSES
) + f" FROM ({SCORED_EVENTS}) GROUP BY expected")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(metrics.confusion(scored_events(spark, sf_dir)), EVENT_CLASSES).drop("task")


@query(sql.metrics(SCORED_EVENTS, EVENT_TASK))
def multiclass_metrics(spark, sf_dir):
    return evaluate_scored(scored_events(spark, sf_dir), event_specs()).metrics


@query(sql.per_class(SCORED_EVENTS, EVENT_TASK))
def multiclass_per_class(spark, sf_dir):
    return evaluate_scored(scored_events(spark, sf_dir), event_specs()).per_class


@query(sql.metrics(SCORED_DOCUMENTS, DOC_TASK))
def binary_metrics(spark, sf_dir):
    return evaluate_scored(scored_documents(spark, sf_dir), quality_specs()).metrics


@query(sql.per_class(SCORED_DOCUMENTS, DOC_TASK))
def binary_per_class(spark, sf_dir):
    return evaluate_scored(scored_documents(spark, sf_dir), quality_specs()).per_class


@query(sql.metric_table(SCORED_DOCUMENTS, DOC_TASK) + f"""
SELECT task, {sql.rounded('accuracy', 4)} AS accuracy, {sql.rounded('"precision"', 4)} AS "precision",
  {sql.rounded('recall', 4)} AS recall, {sql.rounded('f1', 4)} AS f1, quality_gate_passed FROM m""")
def rounded_metrics(spark, sf_dir):
    table_ = metrics.rounded(evaluate_scored(scored_documents(spark, sf_dir), quality_specs()).metrics)
    return table_.select("task", "accuracy", "precision", "recall", "f1", "quality_gate_passed")


WORD_TASK = [("words", "multiclass", 0.95, WORDS)]


@query(CHAT_LABELS + ", s AS (SELECT 'words' AS task, expected, predicted FROM named), mm AS (" + sql.metrics(
    "SELECT * FROM s", WORD_TASK) + ") SELECT * FROM mm")
def skipped_chats_metrics(spark, sf_dir):
    """Chats without an answer count in n but in no class."""
    chats = label_chats(table(spark, sf_dir, "conversations"), WORDS).withColumn("task", F.lit("words"))
    specs = task_specs([{"task": "words", "task_type": "multiclass", "classes": WORDS}])
    return evaluate_scored(chats, specs).metrics


MULTI = [
    ("first", "binary", 0.4, ["THE", "ICH"]),
    ("second", "multiclass", 0.5, ["THAT", "NICHT", "LES"]),
    ("third", "binary", 0.95, ["UND", "OF"]),
]
MULTI_ORDER = {"first": ["THE", "ICH"], "second": ["NICHT", "THAT", "LES"], "third": ["UND", "OF"]}


def multi_specs():
    return task_specs([
        {"task": t, "task_type": k, "quality_gate": g, "classes": c, "max_test_samples": None} for t, k, g, c in MULTI
    ])


def multi_turns(spark, sf_dir):
    names = F.array(*[F.lit(t) for t, _, _, _ in MULTI])
    return table(spark, sf_dir, "conversations").withColumn("task", F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int")))


def multi_label(text):
    return "CASE task " + " ".join(
        f"WHEN '{t}' THEN {sql.label(text, c, MULTI_ORDER[t])}" for t, _, _, c in MULTI) + " END"


MULTI_SCORED = f"""
SELECT task, CASE WHEN answer <> '' THEN {multi_label('answer')} END AS expected,
  CASE WHEN answer <> '' THEN {multi_label("CASE WHEN contains(prompt, 'ich') THEN 'ich und les' ELSE 'that, of the' END")} END AS predicted
FROM (
    SELECT conv_id, ['first', 'second', 'third'][conv_id % 3 + 1] AS task, prompt, answer
    FROM (SELECT conv_id, string_agg(piece, chr(10) ORDER BY turn) AS prompt FROM pieces GROUP BY conv_id)
    JOIN (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id) USING (conv_id))"""


@query(PROMPT_PIECES + ", chats AS (" + MULTI_SCORED + "), mm AS (" + sql.metrics("SELECT * FROM chats", MULTI) + ") SELECT * FROM mm")
def multi_task_metrics(spark, sf_dir):
    """Three tasks, all their chats, scored by a predictor and evaluated in one job."""
    specs = multi_specs()
    prepared = prepare_turns(multi_turns(spark, sf_dir), specs)
    answers = respond(prepared, keyword_predictor("ich", "ich und les", "that, of the"))
    return evaluate_scored(label_responses(answers, specs), specs).metrics


def document_chats(spark, sf_dir):
    """Documents with known quality as three-message examples."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(
        F.lit("quality").alias("task"), F.col("doc_id").alias("example_id"), F.col("doc_id").alias("seq"), "toxic",
        F.lit("Is this text good or bad?").alias("instruction"), F.col("text").alias("input"),
        F.when(F.col("quality") == 1, "Good, all in all.").otherwise("BAD").alias("output"),
    )
    return to_messages(rows)


MODEL_SCORED = """
SELECT 'quality' AS task, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS expected,
  CASE WHEN contains(text, 'ich') THEN 'GOOD' ELSE 'BAD' END AS predicted
FROM documents JOIN labels USING (doc_id)"""


@query(sql.metrics(MODEL_SCORED, DOC_TASK))
def predictor_metrics(spark, sf_dir):
    """Nested examples through a predictor, every labelled document."""
    chats = document_chats(spark, sf_dir)
    return evaluate(chats, quality_specs(), keyword_predictor("ich", "good.", "it is bad"), keep=False).metrics


REPEATED_SCORED = """
SELECT 'quality' AS task, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS expected,
  CASE WHEN lang = 'en' THEN 'GOOD' ELSE 'BAD' END AS predicted
FROM documents JOIN labels USING (doc_id)"""


@query(sql.metric_table(REPEATED_SCORED, DOC_TASK) + """
SELECT task, total_samples, correct, tp, fp, fn, tn, accuracy, (SELECT count(DISTINCT coalesce(lang, 'None')) FROM documents JOIN labels USING (doc_id)) AS n_asked
FROM m""")
def repeated_prompts_metrics(spark, sf_dir):
    """Every labelled document by a prompt that holds its language only: each distinct prompt is asked once."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    chats = to_messages(docs.select(
        F.lit("quality").alias("task"), F.col("doc_id").alias("example_id"), F.col("lang").alias("question"),
        F.when(F.col("quality") == 1, "Good, all in all.").otherwise("BAD").alias("answer"),
    ))
    folder = new_folder(spark, "scoring")
    scored = score_examples(chats, quality_specs(), keyword_predictor("user\nen<", "good", "bad"), folder=folder)
    result = evaluate_scored(scored, quality_specs()).metrics
    n_asked = sum(spark.read.parquet(f"{folder}/answers-{WAVES}-{k}").count() for k in range(WAVES))
    return result.select("task", "total_samples", "correct", "tp", "fp", "fn", "tn", "accuracy", F.lit(n_asked).cast("long").alias("n_asked"))


STORED_SCORED = """
SELECT 'quality' AS task, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS expected,
  CASE WHEN toxic = 0 AND doc_id % 10 <> 0 THEN 'GOOD' WHEN doc_id % 10 <> 0 THEN 'BAD' END AS predicted
FROM documents JOIN labels USING (doc_id)"""


@query(sql.metrics(STORED_SCORED, DOC_TASK))
def stored_answer_metrics(spark, sf_dir):
    """Answers generated elsewhere and joined; every tenth document has none."""
    answers = table(spark, sf_dir, "labels").where(F.col("doc_id") % 10 != 0).select(
        F.lit("quality").alias("task"), F.col("doc_id").alias("example_id"),
        F.when(F.col("toxic") == 0, "a good one").otherwise("quite bad").alias("response"),
    )
    return evaluate_stored(document_chats(spark, sf_dir).drop("toxic"), quality_specs(), answers).metrics


#: Naive Bayes over the words of the prompts, made again from the tables.
BAYES = f"""
chats AS (
  SELECT doc_id AS example_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label,
    CAST('0x' || md5(CAST(doc_id AS VARCHAR))[:4] AS BIGINT) % 4 = 0 AS held_out,
    '<|im_start|>system' || chr(10) || {HELPER} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Is this text good or bad?' ||
      CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || text END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' AS prompt
  FROM documents JOIN labels USING (doc_id)),
words AS (SELECT example_id, label, held_out, unnest(regexp_extract_all(lower(prompt), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM chats),
counts AS (
  SELECT word, count(*) FILTER (WHERE label = 'GOOD') AS good, count(*) FILTER (WHERE label = 'BAD') AS bad FROM words WHERE NOT held_out GROUP BY word),
sizes AS (SELECT CAST(count(*) AS DOUBLE) AS v, sum(good) AS good, sum(bad) AS bad FROM counts),
base AS (
  SELECT ln(count(*) FILTER (WHERE label = 'GOOD') / count(*)) AS good, ln(count(*) FILTER (WHERE label = 'BAD') / count(*)) AS bad
  FROM chats WHERE NOT held_out),
sums AS (
  SELECT example_id, sum(ln((c.good + 1) / (s.good + v))) AS good, sum(ln((c.bad + 1) / (s.bad + v))) AS bad
  FROM words JOIN counts c USING (word), sizes s GROUP BY example_id),
judged AS (
  SELECT example_id, label, held_out, CASE WHEN coalesce(s.good, 0) + b.good >= coalesce(s.bad, 0) + b.bad THEN 'GOOD' ELSE 'BAD' END AS predicted
  FROM chats LEFT JOIN sums s USING (example_id), base b)"""


def held_out_quarter():
    return F.conv(F.substring(F.md5(F.col("example_id").cast("string")), 1, 4), 16, 10).cast("int") % 4 == 0


def trained(spark, sf_dir):
    """Every labelled document with the prediction of a model fitted on three quarters of them, by way of its written weights."""
    rows = classifier.training_rows(document_chats(spark, sf_dir), ["good", "bad"])
    marked, path = rows.withColumn("held_out", held_out_quarter()), new_folder(spark, "model")
    classifier.fit_word_model(marked.where("NOT held_out"), ["good", "bad"]).write(path)
    return classifier.predict_words(classifier.read_word_model(spark, path), marked)


@query("WITH " + BAYES + " SELECT example_id, label, held_out, predicted FROM judged")
def classifier_labels(spark, sf_dir):
    """All labelled documents, labelled by a trained model; the model has not seen those held out."""
    return trained(spark, sf_dir).select("example_id", "label", "held_out", "predicted")


@query("WITH " + BAYES + ", mm AS (" + sql.metrics(
    "SELECT 'quality' AS task, label AS expected, predicted FROM judged WHERE held_out", DOC_TASK) + ") SELECT * FROM mm")
def classifier_metrics(spark, sf_dir):
    """Train, then evaluate on the rows held out."""
    scored = trained(spark, sf_dir).where("held_out").selectExpr("'quality' AS task", "label AS expected", "predicted")
    return evaluate_scored(scored, quality_specs()).metrics


@query()
def classifier_pipeline(spark, sf_dir):
    """The same rows by a Spark ML pipeline; its solver has no SQL form."""
    rows = classifier.training_rows(document_chats(spark, sf_dir), ["good", "bad"]).withColumn("held_out", held_out_quarter())
    model = classifier.fit_label_model(rows.where("NOT held_out"), ["good", "bad"], features=1 << 14, iterations=10, penalties=(0.1,))
    return classifier.predict_labels(model, rows, ["good", "bad"]).select("example_id", "label", "held_out", "predicted")


def percent_sql(x, digits=1):
    return f"printf('%.{digits}f', {x} * 100) || '%'"


@query(sql.metric_table(SCORED_DOCUMENTS, DOC_TASK) + f""",
r AS (SELECT *, {sql.rounded('accuracy', 4)} AS a4, {sql.rounded('"precision"', 4)} AS p4, {sql.rounded('recall', 4)} AS r4, {sql.rounded('f1', 4)} AS f4 FROM m),
c AS (SELECT task, string_agg('  ' || label || ': ' || {percent_sql(sql.rounded(sql.ratio('tp', 'samples'), 4))} || ' (' || tp || '/' || samples || ')', chr(10) ORDER BY pos) AS lines
  FROM per WHERE samples > 0 GROUP BY task)
SELECT task, 'Accuracy: ' || {percent_sql('a4')} || ' | F1: ' || {percent_sql('f4')} || chr(10) ||
  'Precision: ' || {percent_sql('p4')} || ' | Recall: ' || {percent_sql('r4')} || chr(10) ||
  'TP=' || tp || ' FP=' || fp || ' FN=' || fn || ' TN=' || tn || chr(10) || chr(10) ||
  'Per-class breakdown:' || chr(10) || c.lines || chr(10) || chr(10) ||
  'Quality Gate (' || {percent_sql('quality_gate', 0)} || '): ' || CASE WHEN quality_gate_passed THEN 'PASS' ELSE 'FAIL' END AS report
FROM r JOIN c USING (task)""")
def summary_text(spark, sf_dir):
    lines = evaluate_scored(scored_documents(spark, sf_dir), quality_specs()).lines()
    return lines.select("task", F.array_join("lines", "\n").alias("report"))


@query(sql.metric_table(SCORED_DOCUMENTS, DOC_TASK) + f"""
SELECT task, 'Task: quality' || chr(10) || 'Model: org/Model-1B' || chr(10) || 'Accuracy: ' || {percent_sql(sql.rounded('accuracy', 4))} ||
  chr(10) || 'F1: ' || {percent_sql(sql.rounded('f1', 4))} || chr(10) || 'Train time: ' || printf('%.1f', minutes) || ' min' || chr(10) ||
  'Output: outputs/quality' || chr(10) || CASE WHEN quality_gate_passed THEN 'Quality gate passed.' ELSE 'Quality gate NOT passed.' END AS report
FROM m, (SELECT CAST(printf('%.1f', max(n_chars) / 60.0) AS DOUBLE) AS minutes FROM documents)""")
def run_summary_text(spark, sf_dir):
    result = evaluate_scored(scored_documents(spark, sf_dir), quality_specs()).metrics
    run = table(spark, sf_dir, "documents").agg(F.expr("max(n_chars) / 60 AS minutes")).selectExpr(
        "'quality' AS task", "'org/Model-1B' AS model", "'outputs/quality' AS output",
        f"{exact_sql('minutes', 1)} AS train_time_minutes", "CAST(NULL AS STRING) AS overfitting_warning",
    )
    return run_summary(result, run).select("task", F.array_join("lines", "\n").alias("report"))


@query(sql.metric_table(SCORED_EVENTS, EVENT_TASK) + f"""
SELECT task, 'org/Model-1B' AS base_model, 'multiclass' AS task_type, {sql.rounded('accuracy', 4)} AS accuracy, {sql.rounded('f1', 4)} AS f1,
  total_samples, quality_gate_passed AS passed, 6 AS n_classes, (SELECT count(*) FROM per WHERE samples > 0) AS n_seen,
  (SELECT tp FROM per WHERE label = 'CLICK') AS click_tp, (SELECT count(DISTINCT user_id) FROM events) * 1000000 AS total_parameters
FROM m""")
def report_cards(spark, sf_dir):
    """Model cards, written as JSON and read back field by field."""
    result = evaluate_scored(scored_events(spark, sf_dir), event_specs())
    bench = table(spark, sf_dir, "events").agg((F.count_distinct("user_id") * 1000000).alias("total_parameters")).select(
        F.lit("events").alias("task"), F.lit("org/Model-1B").alias("base_model"), "total_parameters"
    )
    path = new_folder(spark, "cards")
    report.write_report(report.build_report(result.metrics, result.per_class, bench, event_specs()), path)
    cards = report.read_report(spark, path)
    schema = (
        "base_model STRING, task_type STRING, metrics STRUCT<accuracy: DOUBLE, f1: DOUBLE, total_samples: BIGINT, "
        "quality_gate_passed: BOOLEAN, per_class: MAP<STRING, STRUCT<samples: BIGINT, tp: BIGINT>>>, "
        "benchmark STRUCT<total_parameters: BIGINT>"
    )
    m, c = F.col("c.metrics"), F.col("c.metrics.per_class")
    return cards.select("task", F.from_json("card", schema).alias("c")).select(
        "task", "c.base_model", "c.task_type", m["accuracy"].alias("accuracy"), m["f1"].alias("f1"),
        m["total_samples"].alias("total_samples"), m["quality_gate_passed"].alias("passed"), F.size(c).alias("n_classes"),
        F.size(F.filter(F.map_values(c), lambda v: v["samples"] > 0)).cast("bigint").alias("n_seen"),
        c["CLICK"]["tp"].alias("click_tp"), F.col("c.benchmark.total_parameters"),
    )


@query("WITH mm AS (" + sql.metrics(SCORED_EVENTS + " WHERE user_id % 5 <> 0", EVENT_TASK) + ") SELECT * FROM mm")
def merged_metrics(spark, sf_dir):
    """Events added in two batches and partly withdrawn, then evaluated from the stored counts."""
    path = new_folder(spark, "evaluation")
    scored = scored_events(spark, sf_dir, "user_id", "event_id")
    evaluations.append_scored(scored.where("event_id % 3 = 0"), path, "first")
    evaluations.append_scored(scored.where("event_id % 3 <> 0"), path, "second")
    evaluations.withdraw_scored(scored.where("user_id % 5 = 0"), path, "left")
    return evaluate_counts(evaluations.stored_counts(spark, path), event_specs()).metrics


# ---- timings, sizes, runs ------------------------------------------------------


def event_timings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("model"), F.when(F.col("event_type").isin("click", "view"), "fp16").otherwise("int4").alias("variant"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("run_no"), (F.col("value") / 1000).alias("seconds"),
    )


TIMINGS = """
t AS (SELECT user_id AS model, CASE WHEN event_type IN ('click', 'view') THEN 'fp16' ELSE 'int4' END AS variant,
  CAST(props->>'$.k' AS INT) + 1 AS run_no, value / 1000 AS seconds FROM events),
s AS (SELECT model, variant, count(*) AS runs, CAST(sum(CAST(seconds AS DECIMAL(24,9))) AS DOUBLE) / count(*) AS mean
  FROM t WHERE run_no > 3 GROUP BY model, variant),
l AS (SELECT model, variant, runs, mean * 1000 AS avg_latency_ms, CASE WHEN mean <> 0 THEN 32.0 / mean END AS tokens_per_second FROM s)"""


@query(f"WITH {TIMINGS} SELECT * FROM l")
def latency_summary(spark, sf_dir):
    return timings.latency_summary(event_timings(spark, sf_dir))


def benchmark_rows(spark, sf_dir):
    models = table(spark, sf_dir, "events").select(F.col("user_id").alias("model")).distinct().withColumn(
        "total_parameters", (F.col("model") + 1) * 12345678)
    return timings.benchmark_report(timings.latency_summary(event_timings(spark, sf_dir)), models)


BENCH_ROWS = f"""{TIMINGS},
b AS (SELECT model, variant, (model + 1) * 12345678 AS total_parameters,
  {sql.rounded("CAST((model + 1) * 12345678 AS DOUBLE) * CASE variant WHEN 'fp16' THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END / 1e6", 1)} AS size_mb,
  {sql.rounded('avg_latency_ms', 1)} AS avg_latency_ms, {sql.rounded('tokens_per_second', 1)} AS tokens_per_second FROM l)"""


@query(f"WITH {BENCH_ROWS} SELECT * FROM b")
def benchmark_report(spark, sf_dir):
    return benchmark_rows(spark, sf_dir)


@query(f"""
WITH {BENCH_ROWS},
w AS (SELECT model, max(size_mb) FILTER (variant = 'fp16') AS fp16_size_mb, max(size_mb) FILTER (variant = 'int4') AS int4_size_mb,
  max(avg_latency_ms) FILTER (variant = 'fp16') AS fp16_latency_ms, max(avg_latency_ms) FILTER (variant = 'int4') AS int4_latency_ms
  FROM b GROUP BY model)
SELECT *, printf('%.0f', (1 - int4_size_mb / fp16_size_mb) * 100) || '%' AS size_reduction FROM w""")
def compare_variants(spark, sf_dir):
    return timings.compare_variants(benchmark_rows(spark, sf_dir))


@query(sql.metric_table(SCORED_EVENTS, EVENT_TASK) + """,
times AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'fp16' ELSE 'int4' END AS variant,
    CAST(sum(CAST(value / 1000 AS DECIMAL(24,9))) AS DOUBLE) / count(*) AS mean
  FROM events WHERE CAST(props->>'$.k' AS INT) + 1 > 3 GROUP BY 1),
size AS (SELECT CAST(count(DISTINCT user_id) * 1000000 AS DOUBLE) AS p FROM events),
shown AS (SELECT """ + ", ".join([
    sql.rounded("(SELECT p FROM size) * CAST(2.0 AS DOUBLE) / 1e6", 1) + " AS fp16_size_mb",
    sql.rounded("(SELECT p FROM size) * CAST(0.6 AS DOUBLE) / 1e6", 1) + " AS int4_size_mb",
    sql.rounded("(SELECT mean * 1000 FROM times WHERE variant = 'fp16')", 1) + " AS fp16_latency_ms",
    sql.rounded("(SELECT mean * 1000 FROM times WHERE variant = 'int4')", 1) + " AS int4_latency_ms",
]) + f""")
SELECT task, 'org/Model-1B' AS base_model, {sql.rounded('accuracy', 4)} AS accuracy, {sql.rounded('f1', 4)} AS f1, shown.*,
  printf('%.0f', (1 - int4_size_mb / fp16_size_mb) * 100) || '%' AS size_reduction,
  'chatgauge-events-model-1b' AS name, 'outputs/events' AS path, fp16_size_mb AS size_mb
FROM m, shown""")
def exported_models(spark, sf_dir):
    """Evaluation and benchmark to a card and a registry entry, both read back."""
    cards, entries = new_folder(spark, "cards"), new_folder(spark, "registry")
    timed = event_timings(spark, sf_dir).withColumn("model", F.lit("org/Model-1B"))
    sizes = table(spark, sf_dir, "events").agg((F.count_distinct("user_id") * 1000000).alias("total_parameters"))
    models = spark.createDataFrame([("events", "org/Model-1B", "outputs/events")], "task STRING, base_model STRING, path STRING")
    bench = timings.benchmark_report(timings.latency_summary(timed), sizes.withColumn("model", F.lit("org/Model-1B")))
    result = evaluate_scored(scored_events(spark, sf_dir), event_specs(), keep=True)
    report.export_models(result, bench, models, event_specs(), cards, entries)
    names = ["fp16_size_mb", "int4_size_mb", "fp16_latency_ms", "int4_latency_ms"]
    compared = ", ".join(f"{c}: DOUBLE" for c in names) + ", size_reduction: STRING"
    schema = f"base_model STRING, metrics STRUCT<accuracy: DOUBLE, f1: DOUBLE>, benchmark STRUCT<comparison: STRUCT<{compared}>>"
    card = report.read_report(spark, cards).select("task", F.from_json("card", schema).alias("c")).select(
        "task", "c.base_model", "c.metrics.accuracy", "c.metrics.f1", "c.benchmark.comparison.*"
    )
    return card.join(registry.registry_list(spark, entries).select("task", "name", "path", "size_mb"), "task")


def loss_runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), (F.col("l_extendedprice") / 10).alias("train_seconds"),
        (F.col("l_discount") * 10).alias("train_loss"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") * F.col("l_quantity")).alias("eval_loss"), F.col("l_partkey").alias("steps"),
    )


RUNS = """
r AS (SELECT l_orderkey * 10 + l_linenumber AS run, l_extendedprice / 10 AS train_seconds, l_discount * 10 AS train_loss,
  CASE WHEN l_returnflag <> 'R' THEN l_tax * l_quantity END AS eval_loss, l_partkey AS steps FROM lineitem),
f AS (SELECT *, CASE WHEN eval_loss <> 0 AND train_loss <> 0 AND eval_loss - train_loss > 0.1::DOUBLE THEN
  'OVERFITTING DETECTED: eval_loss (' || printf('%.4f', eval_loss) || ') >> train_loss (' || printf('%.4f', train_loss) ||
  '), gap=' || printf('%.4f', eval_loss - train_loss) || '. Consider: fewer steps, higher dropout, or more data.' END AS overfitting_warning FROM r)"""


@query(f"WITH {RUNS} SELECT * FROM f")
def overfit_flags(spark, sf_dir):
    return runs.overfit_flags(loss_runs(spark, sf_dir))


@query(f"""WITH {RUNS}
SELECT run, {sql.rounded('train_seconds / 60', 1)} AS train_time_minutes, {sql.rounded('train_loss', 4)} AS final_loss,
  CASE WHEN eval_loss <> 0 THEN {sql.rounded('eval_loss', 4)} END AS eval_loss, steps AS steps_completed, overfitting_warning FROM f""")
def run_metrics(spark, sf_dir):
    return runs.run_metrics(loss_runs(spark, sf_dir))


# ---- registry ------------------------------------------------------------------


def supplier_models(spark, sf_dir):
    """Suppliers as models; a name occurs once per nation and balance sign."""
    task = F.concat(F.lit("task-"), F.col("s_nationkey").cast("string"))
    model = F.concat(F.lit("Org/Model-"), F.when(F.col("s_acctbal") < 0, "Minus").otherwise("Plus"))
    return table(spark, sf_dir, "supplier").select(
        registry.entry_name(task, model).alias("name"), task.alias("task"), F.concat(F.lit("outputs/"), "s_name").alias("path"),
        (F.col("s_acctbal") / 20000).alias("accuracy"), (F.col("s_acctbal") / 25000).alias("f1"),
        (F.col("s_suppkey") * 2.5).alias("size_mb"), F.col("s_suppkey").alias("seq"),
    )


ENTRIES = """
e AS (SELECT 'chatgauge-task-' || s_nationkey || '-model-' || CASE WHEN s_acctbal < 0 THEN 'minus' ELSE 'plus' END AS name,
  'task-' || s_nationkey AS task, 'outputs/' || s_name AS path, s_acctbal / 20000 AS accuracy, s_acctbal / 25000 AS f1,
  CAST(s_suppkey * 2.5 AS DOUBLE) AS size_mb, s_suppkey AS seq FROM supplier)"""
GONE = "chatgauge-task-3-model-plus"


def written_registry(spark, sf_dir):
    path = new_folder(spark, "registry")
    registry.registry_append(supplier_models(spark, sf_dir), path)
    return path


@query(f"WITH {ENTRIES} SELECT * FROM e WHERE name <> '{GONE}'")
def registry_after_removal(spark, sf_dir):
    """Append, remove a name and list, on a table in the shared folder."""
    path = written_registry(spark, sf_dir)
    registry.registry_remove(spark, path, GONE)
    registry.registry_remove(spark, path, "not there")
    return registry.registry_list(spark, path).drop("registered_at", "version")


@query(f"WITH {ENTRIES} SELECT * FROM e WHERE name = 'task-15' OR task = 'task-15' ORDER BY seq LIMIT 1")
def registry_find(spark, sf_dir):
    entries = registry.registry_entries(supplier_models(spark, sf_dir))
    return registry.registry_find(entries, "task-15").drop("registered_at", "removed", "version", "entry_id")


@query(f"WITH {ENTRIES} SELECT name, task, seq FROM e WHERE name <> '{GONE}'")
def registry_without_name(spark, sf_dir):
    return registry.without_name(supplier_models(spark, sf_dir), GONE).select("name", "task", "seq")


# ---- files ---------------------------------------------------------------------


@query("""
SELECT conv_id, count(*) AS n, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS expected
FROM conversations GROUP BY conv_id""")
def jsonl_source(spark, sf_dir):
    """Chats written as JSON lines turn by turn, every other one as a bare list, and read back."""
    path = new_folder(spark, "jsonl")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = turns.select("conv_id").distinct().selectExpr("conv_id", "-1 AS turn", "'id' AS role", "CAST(conv_id AS STRING) AS text")
    write_chats(turns.unionByName(ids), path, bare=F.col("conv_id") % 2 == 1)
    read = files.load_train(spark, path, shipped_specs()[0], format="jsonl", positions=False)
    m = F.col("messages")
    return read.select(
        m[0]["content"].cast("bigint").alias("conv_id"), (F.size(m) - 1).cast("bigint").alias("n"), chat.last_assistant("messages").alias("expected")
    )


def event_lines(spark, sf_dir):
    """Events as JSON lines in one ordered folder; returns its path."""
    path = new_folder(spark, "events")
    example = F.struct(
        F.col("event_type").alias("instruction"), F.col("event_id").cast("string").alias("input"),
        F.col("user_id").cast("string").alias("output"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(example).alias("value"))
    rows.orderBy("event_id").select("value").write.text(path)
    return path


def loaded(examples):
    """(kind, event_id, user_id) taken from the messages again."""
    m = F.col("messages")
    asked = F.split(m[1]["content"], "\n\n")
    return examples.select(
        asked[0].alias("kind"), asked[1].cast("bigint").alias("event_id"),
        F.element_at(m, -1)["content"].cast("bigint").alias("user_id"),
    )


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 700")
def load_train_capped(spark, sf_dir):
    """The first 700 training examples of JSON lines."""
    spec = task_specs([{"task": "events", "max_samples": 700}])[0]
    return loaded(files.load_train(spark, event_lines(spark, sf_dir), spec)).select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type AS kind FROM events ORDER BY event_id LIMIT 300")
def load_test_capped(spark, sf_dir):
    """The first 300 test examples of a table."""
    path, spec = new_folder(spark, "test"), task_specs([{"task": "events", "max_val_samples": 300}])[0]
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("instruction"), F.col("event_id").cast("string").alias("input"),
        F.col("user_id").cast("string").alias("output"),
    )
    rows.orderBy("event_id").drop("event_id").write.parquet(path)
    return loaded(files.load_test(spark, path, spec, format="parquet"))


@query(f"""
SELECT '<|im_start|>system' || chr(10) || {HELPER} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || url || '<|im_end|>' ||
  chr(10) || '<|im_start|>assistant' || chr(10) || html || '<|im_end|>' AS text FROM pages""")
def training_text_sink(spark, sf_dir):
    """Training texts of a split dataset: written as parquet, loaded, rendered, written, read."""
    root, out = new_folder(spark, "dataset"), new_folder(spark, "texts")
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("prompt"), F.col("html").alias("completion"))
    rows.write.parquet(f"{root}/train")
    split, _ = files.read_split(spark, root, "validation", ["train"])
    write_training_text(to_messages(split), out)
    return spark.read.parquet(out)


@query(f"""
SELECT {sql.first_tokens("'<|im_start|>user' || chr(10) || text || '<|im_end|>'", 512)[1]} AS text FROM documents""")
def training_text_capped(spark, sf_dir):
    """Training texts cut at the smallest of the three training lengths."""
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    rows = table(spark, sf_dir, "documents").select(F.array(message).alias("messages"))
    return training_text(rows, max_tokens=512)


@query("""
SELECT * FROM (VALUES ('hdfs-anomaly', 'binary', 'ANOMALY,NORMAL', 0.96::DOUBLE, 500), ('cve-analysis', 'multiclass', 'CRITICAL,HIGH,MEDIUM,LOW', 0.95::DOUBLE, 1000),
  ('phishing-detection', 'binary', 'PHISHING,LEGITIMATE', 0.95::DOUBLE, 1000)) t(task, task_type, classes, quality_gate, max_test_samples)
JOIN (SELECT ['hdfs-anomaly', 'cve-analysis', 'phishing-detection'][conv_id % 3 + 1] AS task, count(DISTINCT conv_id) AS chats FROM conversations GROUP BY 1) USING (task)""")
def task_settings(spark, sf_dir):
    """The shipped settings next to the number of chats assigned to each task."""
    specs = shipped_specs()
    names = F.array(*[F.lit(s.task) for s in specs])
    chats = table(spark, sf_dir, "conversations").groupBy(
        F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int")).alias("task")).agg(F.count_distinct("conv_id").alias("chats"))
    settings = spec_frame(spark, specs).select(
        "task", "task_type", F.array_join("classes", ",").alias("classes"), "quality_gate", F.col("max_test_samples").cast("int").alias("max_test_samples"))
    return chats.join(F.broadcast(settings), "task")
