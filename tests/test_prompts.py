import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from markbook.functions import blocks, render
from markbook.operators import fewshot
from markbook.operators.conversations import message_parts, ordered_messages, whole_prompts
from markbook.plans.backends import BACKENDS
from markbook.plans.evaluate import build_prompts

BANK = "subject string, split string, row_idx long, question string, A string, B string, C string, D string, answer string, explanation string"
HEAD = "以下是關於數學考試單選題，請選出正確的答案。"
SYSTEM = "你是一位專業的中文AI助理，" + HEAD
STEM = "Q{0}\nA. a{0}\nB. b{0}\nC. c{0}\nD. d{0}"


@pytest.fixture(scope="module")
def bank(spark):
    def row(i, split):
        return ("math", split, i, f"Q{i}", f"a{i}", f"b{i}", f"c{i}", f"d{i}", "ABCD"[i % 4], f"e{i}")

    # Worked examples arrive out of order; row_idx decides.
    rows = [row(i, "train") for i in (3, 1, 2, 0)] + [row(9, "test")]
    return spark.createDataFrame(rows, BANK)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("math", "數學")], "subject string, name string")


def one(df, column):
    return df.select(column).collect()[0][0]


def test_block_shapes(bank):
    test = bank.where("split = 'test'")
    stem = STEM.format(9)
    options = stem.removeprefix("Q9")
    assert one(test, blocks.question_block()) == stem + "\n答案："
    assert one(test, blocks.exemplar_block()) == stem + "\n答案：B\n\n"
    assert one(test, blocks.question_block(("A", "B"))) == "Q9\nA. a9\nB. b9\n答案："
    worked = "讓我們一步一步思考，\ne9\n所以答案是B。"
    user, assistant = one(test, blocks.exemplar_messages(cot=True))
    assert (user["role"], user["content"], assistant["content"]) == ("user", stem + "\n答案：", worked)
    assert one(test, blocks.base_block()) == f"問題：{stem}\n答案：\n答案："
    assert one(test, blocks.base_block(cot=True)) == f"問題：{stem}\n答案：\n答案：讓我們一步一步思考，\n"
    assert one(test, blocks.base_block(answered=True)) == f"問題：{stem}\n答案：\n答案：B\n\n"
    assert one(test, blocks.base_block(answered=True, cot=True)) == f"問題：{stem}\n答案：{worked}\n\n"
    pair = one(test, blocks.history_pair())
    assert pair["query"] == "問題：Q9\n\nA. a9\nB. b9\nC. c9\nD. d9\n\n答案：" and pair["answer"] == "\n答案：B\n\n"
    instruct = f"問題：Q9\n\n{options}\n答案："
    assert one(test, blocks.instruct_block()) == instruct + "\n答案："
    assert one(test, blocks.instruct_block(cot=True)) == instruct + "\n答案：讓我們一步一步思考，\n1."
    assert one(test, blocks.instruct_block(cot=True, with_prompt=True)) == instruct + "\n答案是什麼？讓我們一步一步思考，\n1."
    assert one(test, blocks.instruct_block(answered=True)) == instruct + "\n答案：B\n\n"
    assert one(test, blocks.instruct_block(answered=True, cot=True, compat=True)) == instruct


def test_message_context_order_and_headers(bank, names):
    dev = bank.where("split = 'train'")
    context = fewshot.message_context(dev, 2, names).collect()[0]["context"]
    assert [m["role"] for m in context] == ["system", "user", "assistant", "user", "assistant"]
    assert context[0]["content"] == SYSTEM
    assert context[1]["content"] == HEAD + "\n\n" + STEM.format(0) + "\n答案："
    assert context[3]["content"] == STEM.format(1) + "\n答案：" and context[4]["content"] == "B"
    assert len(fewshot.message_context(dev, -1, names).collect()[0]["context"]) == 9
    assert len(fewshot.message_context(dev, 99, names).collect()[0]["context"]) == 9
    assert len(fewshot.message_context(dev, 3, names, policy="first_only").collect()[0]["context"]) == 3


def test_all_rows_context_has_no_limit(spark, names):
    rows = [("math", "train", i, "q" * 2000, "1", "2", "3", "4", "A", "e") for i in range(2000)]
    dev = spark.createDataFrame(rows, "subject string, split string, row_idx long, question string, A string, B string, C string, D string, answer string, explanation string")
    assert len(fewshot.message_context(dev, -1, names).collect()[0]["context"]) == 4001


def test_top_k_is_limited_before_the_shuffle(bank):
    plan = plan_of(fewshot.exemplar_rows(bank.where("split = 'train'"), 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def prompt(bank, names, backend, **options):
    rows = bank.where("split = 'test'").join(names, "subject")
    return build_prompts(rows, bank.where("split = 'train'"), BACKENDS[backend], names=names, **options).collect()[0]["prompt"]


def test_backend_prompts(bank, names):
    stem = STEM.format(9) + "\n答案："
    assert prompt(bank, names, "tgi") == (
        f"<|im_start|>system\n{SYSTEM}<|im_end|><|im_start|>user\n{HEAD}\n\n{stem}<|im_end|><|im_start|>assistant\n"
    )
    direct = HEAD.replace("請選出", "請直接選出")
    assert prompt(bank, names, "claude") == (
        f"\n\nHuman: {SYSTEM.replace('請選出', '請直接選出')}\n\nHuman: {direct}\n\n{stem}\n\nAssistant:"
    )
    assert prompt(bank, names, "reka", k=1) == (
        f"{SYSTEM}\n{HEAD}\n\n{STEM.format(0)}\n答案：\nA\n{stem}\n"
    )
    import json

    assert json.loads(prompt(bank, names, "gemini")) == [f"{SYSTEM}\n問題: {HEAD}\n\n{stem}\n"]
    pairs = json.loads(prompt(bank, names, "hf_chat", k=1))
    assert pairs["query"].startswith("問題：Q9") and pairs["history"][0]["query"].startswith(HEAD)
    assert json.loads(prompt(bank, names, "hf_chat"))["history"] == []
    assert prompt(bank, names, "hf_base") == f"問題：{STEM.format(9)}\n答案：\n答案："
    assert prompt(bank, names, "mixtral", k=1, with_prompt=True).startswith(
        "[INST] 以下是關於數學考試單選題，請選出正確的答案\n\n [/INST]好的，我會結合數學相關知識回答[INST] Q0"
    )


def test_segments(spark):
    def segments(*roles):
        messages = [(r, f"{r[0]}{i}") for i, r in enumerate(roles)]
        df = spark.createDataFrame([(messages,)], "m array<struct<role string, content string>>")
        return df.select(render.render_segments(F.col("m"))).collect()[0][0]

    assert segments("system", "user", "assistant", "user") == ["s0\n問題: u1\n", "a2\n", "問題: u3\n"]
    assert segments("user", "system", "system", "user", "user") == ["問題: u0\n", "s1\n", "s2\n問題: u3\n", "問題: u4\n"]
    assert segments("tool", "user") == ["問題: u1\n"]


def test_conversation_parts_join_without_a_seam(spark):
    roles = ["system", "user", "assistant", "user", "system", "user", "assistant"]
    turns = [(c, t, roles[t % 7], f"t{c}.{t}") for c in range(3) for t in range(5 + 7 * c)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = message_parts(df, "conv_id", "turn", part_turns=1000)
    split = message_parts(df, "conv_id", "turn", part_turns=2)

    def texts(parts):
        prompts = whole_prompts(parts, "conv_id", render.render_chat(F.col("messages"), closing=F.col("is_last")))
        return {r["conv_id"]: r["prompt"] for r in prompts.collect()}

    at_once = ordered_messages(df, "conv_id", "turn")
    assert texts(split) == texts(whole) == {r["conv_id"]: r["p"] for r in at_once.select("conv_id", render.render_chat(F.col("messages")).alias("p")).collect()}
    assert plan_of(at_once).count("Exchange (") == 1
    assert whole.count() == 3 and split.count() > 3


def test_direct_header_and_tokens(spark):
    df = spark.createDataFrame([("數學", ("S:", "|", "A:", "U:"))], "n string, t struct<system_token:string,end_token:string,assistant_token:string,user_token:string>")
    messages = fewshot.F.array(blocks.message("system", F.col("n")), blocks.message("user", F.lit("hi")))
    text = df.select(render.render_chat(messages, render.column_tokens(F.col("t")))).collect()[0][0]
    assert text == "S:數學|U:hi|A:"


def test_ordered_messages_of_awkward_turns(spark):
    turns = [(1, 2, "user", "b"), (1, None, "system", "first"), (1, 2, "assistant", "a"), (None, 1, "user", "x"), (None, 0, None, None), (2, 1, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in ordered_messages(df, "conv_id", "turn").collect()}
    assert got == {1: [("system", "first"), ("assistant", "a"), ("user", "b")], None: [(None, None), ("user", "x")], 2: [("user", None)]}
    assert ordered_messages(df.limit(0), "conv_id", "turn").count() == 0
