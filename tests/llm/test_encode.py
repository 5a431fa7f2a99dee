import random

from clausewright.llm import encode

V = encode.vocabulary_path()


def texts():
    random.seed(1)
    words = ["don't", "हिन्दी", "测试", "x" * 150, "IS 9:2010", "🔬", "\n\n", "   ", "a", "they'll", "\t"]
    return [None, "", " ", "<|endoftext|>", "plain"] + [random.choice(["", " "]).join(random.choice(words) for _ in range(random.randint(20, 400))) for _ in range(40)] + ["y" * 3000, " " * 3000 + "z"]


def test_pieces_equal_whole(spark):
    rows = [(k, t, [k]) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    tok = encode.tokenizer(V)
    want = {k: tok.encode_ordinary(t or "") for k, t, _ in rows}
    for chunk, overlap in ((200, 80), (64, 64), (16384, 1024)):
        got = {r.doc_id: r.ids for r in encode.encode_table(df, "doc_id", "text", V, chunk, overlap).collect()}
        assert got == want
        counts = {r.doc_id: r.n_tokens for r in encode.encode_table(df, "doc_id", "text", V, chunk, overlap, count_only=True).collect()}
        assert counts == {k: len(v) for k, v in want.items()}
    assert all(encode.decode(want[k], V) == (t or "") for k, t, _ in rows)


def test_empty_table(spark):
    assert encode.encode_table(spark.createDataFrame([], "k string, t string"), "k", "t", V).count() == 0


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(V.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for t in texts():
        assert other.encode(t or "", add_special_tokens=False).ids == encode.tokenizer(V).encode_ordinary(t or "")
