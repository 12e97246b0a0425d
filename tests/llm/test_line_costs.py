import numpy as np

from grainloom.llm import line_dedup


def test_texts_that_keep_their_lines_are_counted_without_a_split(spark, rows):
    texts = [None, "", "one line only here", "a first line of text\n\nits last line\n", "\n", "a line that comes twice\nzwölf weitere Zeichen", "another start\na line that comes twice"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.dedup_lines(df)
    assert rows(got) == [(i, t if i < 6 else "another start", 0 if t is None else len(t.split("\n")), int(i == 6)) for i, t in enumerate(texts)]
    union = got._jdf.queryExecution().optimizedPlan().toString()
    assert union.count("replace(") == 1  # beside the one branch that splits


def test_in_place_hashes_keep_their_input_and_values():
    code = line_dedup.code_points("some text of more than six characters")
    before = code.copy()
    h = np.zeros(len(code) - line_dedup.SHINGLE + 1, np.uint64)
    for j in range(line_dedup.SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + len(h)]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    assert (line_dedup.rolled(code) == (h ^ (h >> np.uint64(33)))).all() and (code == before).all()
