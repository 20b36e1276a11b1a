from tributary.llm import hamming_topk


def test_codes_are_as_long_as_the_longest_vector(spark):
    rows = [(0, [1.0] * 100), (1, [1.0] * 64 + [-1.0] * 36), (2, [1.0] * 96 + [-1.0] * 4), (3, None), (4, [])]
    codes = hamming_topk.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = hamming_topk.topk(codes, codes.where("id = 0"), 4).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(0, 0), (2, 4), (1, 36), (4, 100)]
