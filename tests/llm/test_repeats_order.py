"""Why equal windows are met in groups: neighbours in suffix order alone miss copies that agree to the left."""

from tidemark.llm.repeats import repeated_passages

WINDOW = 50


def neighbours_alone(texts, anchor):
    """Passages found by sorting the suffixes at anchor's places by their words and extending neighbours to both sides."""
    at = sorted((t[t.index(anchor) :], i, t.index(anchor)) for i, t in enumerate(texts))
    found = {}
    for (_, i, p), (_, j, q) in zip(at, at[1:], strict=False):
        a, b = texts[i], texts[j]
        right = next((n for n in range(min(len(a) - p, len(b) - q)) if a[p + n] != b[q + n]), min(len(a) - p, len(b) - q))
        left = next((n for n in range(min(p, q)) if a[p - 1 - n] != b[q - 1 - n]), min(p, q))
        if left + right >= WINDOW:
            for k, x in ((i, p), (j, q)):
                found[k] = max(found.get(k, 0), left + right)
    return found


def texts_of():
    left, gram = [f"l{i}" for i in range(40)], ["anchor", *(f"g{i}" for i in range(19))]
    a = left + gram + ["m", "m", "m"]
    b = left + gram + ["z"]
    c = [f"c{i}" for i in range(40)] + gram + ["m", "m", "a"]
    d = [f"d{i}" for i in range(40)] + gram + ["m", "m", "y"]
    return [a, b, c, d]


def test_neighbours_alone_miss_a_copy_that_groups_find(spark):
    texts = texts_of()
    assert neighbours_alone(texts, "anchor") == {}
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.repeated, r.later) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("0-60", ""), 1: ("0-60", "0-60")}
    assert neighbours_alone(texts[:2], "anchor") == {0: 60, 1: 60}
