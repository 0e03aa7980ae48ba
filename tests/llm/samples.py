"""Texts for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key string, n_words int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(1 + w % 7)) + str(w) for w in (r.randrange(vocabulary) for _ in range(n)))


def corpus() -> list[tuple]:
    """Prose, exact and near copies, shared passages, and the cases every operator must stand: nulls, empty, blank and very long texts, repeated rows and ids."""
    texts = {k: prose(k, 60 + 7 * k % 90) for k in range(40)}
    for k in range(40, 46):
        texts[k] = texts[3]
    for k in range(46, 60):
        w = texts[5].split(" ")
        w[(k * 7) % len(w)] = f"edit{k}"
        texts[k] = " ".join(w)
    passage = prose(999, 60)
    for k in range(60, 66):
        texts[k] = f"{prose(k, 30)} {passage} {prose(k + 100, 20)}"
    texts |= {66: "", 67: "  \n\t ", 68: "one", 69: "Two words", 70: "a a a a " * 40, 71: prose(71, 30000, 5000), 72: "x" * 50000, 73: "Über straße ñandú 你好 😀 é", 74: None, 75: "ONE", 76: "period two " * 60}
    rows = [(k, t, ("en", "de", None)[k % 3], f"src{k % 4}", len(t or ""), 0.5, "mine", 7) for k, t in texts.items()]
    rows += [rows[3], rows[3], (None, texts[3], "en", None, None, None, None, None), (80, texts[4], None, None, None, None, None, None), (80, texts[6], "en", "s", 1, 1.0, "k", 1)]
    return rows
