from provenir.llm.chat_rotation import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def test_each_speaker_gets_a_rendering_with_spans_of_its_own_words(spark):
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob o'b", "hello <|im_end|>", "x"), (1, 3, "ann", "bye", "x")]
    got = {r["perspective"]: r for r in rotate_perspectives(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"ann", "bob o'b"}
    ann = got["ann"]
    assert ann["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob_o_b\nhello <| im_end|>")
    spans = [tuple(map(int, s.split(":"))) for s in ann["loss_spans"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["hi<|im_end|>", "bye<|im_end|>"]
    assert (ann["n_turns"], ann["n_trained"]) == (4, 2)


def test_odd_rows(spark):
    rows = [(1, None, "a", "late", ""), (1, 0, None, None, ""), (None, 0, "a", "x", ""), (2, 0, "system", "alone", ""), (3, 1, "b", "same", ""), (3, 1, "b", "same", ""), (3, 1, "a", "tie", "")]
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in rotate_perspectives(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, "a", -1), (1, "a", 0), (1, "unknown", -1), (1, "unknown", 0), (None, "a", 0), (3, "a", 0), (3, "b", 0)}
    assert got[3, "b", 0]["n_trained"] == 2 and got[3, "b", 0]["text"].index("tie") < got[3, "b", 0]["text"].index("same")
    assert rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_dialogue_comes_in_parts(spark):
    rows = [(1, k, "ab"[k % 2], f"t{k}", "") for k in range(300)]
    got = rotate_perspectives(spark.createDataFrame(rows, SCHEMA), 128).collect()
    assert sorted((r["part"], r["n_turns"]) for r in got if r["perspective"] == "a") == [(0, 128), (1, 128), (2, 44)]
