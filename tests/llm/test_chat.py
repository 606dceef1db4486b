import hashlib
import random

from offermend.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[key] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(6)
    bits = ["\\", "###", "#", "### Assistant: ", "</turn>", "<", "</", "\n", "é", "ok", " ", "</turn>\n", "### Role x: ", ":"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), text()) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(1000, i, text(), text()) for i in range(60)] + [(1001, 0, None, None), (1001, 0, None, None), (None, 1, "user", "no id"), (1002, None, "assistant", "x" * 300_000), (1003, 1, "", "")]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS loss", "'q' AS seq").repartition(3)
    made = chat.segments(frame)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    want = brute(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    chars = {}
    for r in made.collect():
        chars[r["conv_id"]] = chars.get(r["conv_id"], 0) + len(r["text"])
    assert {k: r["formatted_chars"] for k, r in got.items()} == chars


def test_the_machine_judges_the_order(spark):
    said = {1: "system user assistant user assistant", 2: "user assistant user", 3: "assistant", 4: "user user", 5: "user assistant system user", 6: "robot"}
    rows = [(c, i, r, "t") for c, roles in said.items() for i, r in enumerate(roles.split())]
    got = {r["conv_id"]: (r["in_order"], r["complete"]) for r in chat.read_back(chat.segments(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_a_template_is_data(spark):
    own = chat.Template(openings={"user": "<|u|>", "assistant": "<|a|>"}, other=("<|r|", "|>"), end="<|end|>", escape="^", controls=("<|",), trained=frozenset({"user"}))
    rows = [(1, 0, "user", "a<|end|>^"), (1, 1, "assistant", "<|u|>"), (1, 2, "q:^r", "x")]
    made = chat.segments(spark.createDataFrame(rows, SCHEMA), own)
    row = chat.read_back(made, own).first()
    assert (row["turns_sha256"], row["loss_chars"]) == (hashlib.sha256(b"user\na<|end|>^\nassistant\n<|u|>\nq:^r\nx\n").hexdigest(), 9)
    assert "".join(r["text"] for r in made.orderBy("seq").limit(3).collect()) == "<|u|>a^<|end|>^^<|end|>"


def test_empty(spark):
    assert chat.read_back(chat.segments(spark.createDataFrame([], SCHEMA))).count() == 0
