import json

from pyspark.sql import functions as F

from tessera.functions import names, parsers, text
from tessera.functions.keys import strip, summary_key


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", column.alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def test_thinking_is_removed(spark):
    assert values(spark, ["a</think> b</think>c", "<think>a", "plain", None], text.without_thinking(F.col("x"))) == ["b</think>c", "", "plain", None]


def test_cleaned(spark):
    texts = ["user: x\nassistant\n **ok**  it", "the assistant is here", "Assistant: a <|assistant|> b", "“q” ‘r’ `s`\t\n t"]
    assert values(spark, texts, text.cleaned(F.col("x"))) == ["ok it", "the assistant is here", "b", "\"q\" 'r' s t"]


def test_refusal_fast_has_three_states(spark):
    texts = [None, "[MODERATION_BLOCKED]: x", "**I'm sorry, but I cannot** do it", "Sure, but I'm sorry, but I cannot", "抱歉，我无法"]
    assert values(spark, texts, text.refusal_fast(F.col("x"))) == [False, True, True, None, True]


def test_numbered_items(spark):
    assert values(spark, ["1. a\n2. b\r\n3. a\nx 4. c"], text.numbered_items(F.col("x"))) == [["a", "b\r"]]


def test_split_labels_and_plain_words(spark):
    assert values(spark, ["a, b or c,", "x"], text.split_labels(F.col("x"))) == [["a", "b", "c", ""], ["x"]]
    assert values(spark, [" The U.S. is a (big) place. "], text.plain_words(F.col("x"))) == ["the us is (big) place"]


def test_keys(spark):
    assert values(spark, ["　 A-b! ", None], summary_key(F.col("x"))) == ["　 ab ", ""]
    assert values(spark, ["　 a\n"], strip(F.col("x"))) == ["a"]


def test_answers(spark):
    assert values(spark, [r"\boxed{answer: Y}", "none"], text.boxed_letter(F.col("x"), "yn")) == ["n", None]
    assert values(spark, ['\\answer{"A b"}', 'The answer is "c"', "no"], text.answer_name(F.col("x"))) == ["A b", "c", None]
    assert values(spark, ["```json\n[\"a\", \"b\"]\n```", "{", '["c"]'], text.json_strings(F.col("x"))) == [["a", "b"], [], ["c"]]
    assert values(spark, ["a [English: b]", "c"], text.translation(F.col("x"))) == ["b", None]
    assert values(spark, ["Topic: t\n1. a question that is long\n- another long question\nshort"], text.listed_queries(F.col("x"), 2)) == [["a question that is long", "another long question"]]


def test_label_mapping():
    assert parsers.label_mapping('x ```json\n{" A ": ["p", ["q", 1]], "a": "P", " ": ["z"], "B": [" "]}``` y') == {"A": ["p", "q", "1"]}
    assert parsers.label_mapping("no object") is None
    assert parsers.label_mapping('{"a": ["}"') is None
    assert parsers.label_mapping(None) is None


def test_clustering():
    topics = ["t1", "t2", "t3"]
    assert parsers.clustering('<think>{"x":[1]}</think>```json\n{"a": [1, 3],\n"b": [2]}\n```', topics) == ({"a": ["t1", "t3"], "b": ["t2"]}, True, True)
    assert parsers.clustering('{"a": [1, 9]}', topics) == ({"a": ["t1"], "cluster_2": ["t2"], "cluster_3": ["t3"]}, False, False)
    long = "w" * 60
    assert parsers.clustering("nothing", [long, long])[0] == {"w" * 50 + "...": [long], "w" * 50 + "... (2)": [long]}


def test_user_message():
    assert parsers.user_message("<|user|>\nhello\n<|assistant|>\nhi") == "hello"
    assert parsers.user_message("<|begin_of_text|><|start_header_id|>system<|end_header_id|>s<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|>x") == "q"
    assert parsers.user_message("<｜begin▁of▁sentence｜><｜User｜>Query: why<｜Assistant｜>no") == "why"
    assert parsers.user_message("You are a bot") == "" and parsers.user_message(None) == ""


def test_names(spark):
    files = ["/x/crawler_log_20240102_030405_m_1-x_5samples_7crawls_Truefilter_thought_prefill_with_seedprompt_vllm.json", "crawler_out_20240102_030405_m_5samples_7crawls_Truefilter_userprompt_api.json", "other.json"]
    got = values(spark, files, names.parsed_name(F.col("x"), "prompt", "current"))
    assert [(g and (g["model"], g["samples"], g["mode"], g["backend"])) for g in got] == [("m_1-x", 5, "thought_prefill_with_seed", "vllm"), ("m", 5, "user", "api"), None]
    assert values(spark, files, names.mode_of(F.col("x"))) == ["thought", None, None]
    got = values(spark, ["openai:m", "Ollama:m", "unknown:m", "bare"], names.provider_and_model(F.col("x")))
    assert [tuple(g) for g in got] == [("openai", "m"), ("ollama", "m"), ("openrouter", "unknown:m"), ("openrouter", "bare")]


def test_meta_pairs(spark):
    document = json.dumps({"m": {"s": [[{"raw": "a"}, "f"]]}, "flat": [[{"raw": "b"}, "g.json"]]})
    rows = parsers.MetaPairs(F.lit(document)).collect()
    assert {(r["meta"], r["sub"], json.loads(r["topic"])["raw"], r["log_file"]) for r in rows} == {("flat", None, "b", "g.json"), ("m", "s", "a", "f")}
