from lodestone.operators import documents as D


def test_chunks_are_bounded_and_lose_nothing(spark):
    """Sentences without white space, clauses, text without any mark, a short tail."""
    texts = {
        1: "".join(f"第{i}号港口今日停航通知已经发布并且生效。" for i in range(200)),
        2: "".join(f"第{i}段航道管制，" for i in range(300)) + "完。",
        3: "".join(chr(0x4E00 + i % 5000) for i in range(3000)),
        4: "a" * 640 + "." + " " + "b" * 640 + ". tail here.",
        5: " ".join(f"word{i}" for i in range(900)),
        6: "", 7: " \n ", 8: "One. Two!\nThree",
    }
    got = {}
    for r in D.chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert max(len(c) for x in got.values() for c in x) <= 750 and 6 not in got and 7 not in got
    assert all(f"第{i}号港口今日停航通知已经发布并且生效。" in "".join(got[1]) for i in range(200)) and len(got[1]) > 5
    assert all(c.startswith("第") and c.endswith("。") for c in got[1])  # whole sentences
    assert all(f"第{i}段航道管制，" in "".join(got[2]) for i in range(300)) and all(c.startswith("第") for c in got[2])
    assert "".join(got[3]) == texts[3] and [len(c) for c in got[3]] == [650, 650, 650, 650, 400]
    assert got[4] == ["a" * 640 + ".", "b" * 640 + ".", "b" * 640 + ". tail here."]  # the sentence before comes along while 750 allows
    assert sum(len(c.replace(" ", "")) for c in got[5]) == len(texts[5].replace(" ", ""))
    assert got[8] == ["One. Two! Three"]
    tail = D.chunks(spark.createDataFrame([(1, "a" * 640 + "。" + "b" * 20 + "。")], "doc_id long, text string"), overlap=0)
    assert [r.chunk_text for r in tail.collect()] == ["a" * 640 + "。", "b" * 20 + "。"]
    tail = D.chunks(spark.createDataFrame([(1, ("a" * 320 + "。") * 2 + "b" * 20 + "。")], "doc_id long, text string"))
    assert [len(r.chunk_text) for r in tail.collect()] == [642, 342]
    tail = D.chunks(spark.createDataFrame([(1, ("a" * 50 + "。") * 12 + "b" * 50 + "。")], "doc_id long, text string"))
    assert [r.chunk_text for r in tail.collect()] == [("a" * 50 + "。") * 13 + "b" * 50 + "。"]  # the tail with its overlap, as in the reference
