from siftline.operators.lexical import keyword_counts, passages, windows_of


def test_whole_lines_count(corpus):
    files = corpus({"a": "x" * 600 + " needle " + "y" * 600 + " Needle", "b": "needle\n" * 3, "c": None})
    assert {r.path: r.counts for r in keyword_counts(files, ["needle"]).collect()} == {"a": [2], "b": [3], "c": [0]}
    assert {r.path: r.counts for r in keyword_counts(files, ["needle"], clipped=True).collect()} == {"a": [0], "b": [3], "c": [0]}


def test_windows_of_a_long_line():
    text = "first\n" + "é" * 100 + "\nlast\nend"
    found = windows_of(text, 50, [], [])
    assert [(w["start"], w["stop"]) for w in found] == [(1, 1), *[(2, 2)] * 5, (3, 4)]
    assert "".join(w["text"].removeprefix("L2| ").rstrip("\n") for w in found[1:-1]) == "é" * 100
    assert all(len(w["text"].encode()) <= 50 for w in found) and found[-1]["text"] == "L3| last\nL4| end\n"
    assert [(w["start"], w["stop"]) for w in windows_of(text, 50, [], [], clipped=True)] == [(1, 1), (2, 2), (3, 4)]
    assert windows_of("", 50, [], []) == [] and windows_of(None, 50, [], []) == []
    assert [w["text"] for w in windows_of("ab", 3, [], [])] == ["L1| a\n", "L1| b\n"]


def test_all_of_a_long_text_is_in_passages(corpus):
    text = " ".join(f"w{i}" for i in range(9000))
    got = passages(corpus({"a": text}), ["w8999"], [1.0], 1024).collect()
    assert "".join(r.text[4:-1] for r in got) == text and [r.score > 0 for r in got].count(True) == 1
