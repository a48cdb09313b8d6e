"""Tables with every awkward case: nulls, empty and long texts, ties, repeats, and
extra columns whose names the operators use themselves."""

LONG = "lorem ipsum dolor sit amet " * 20_000
CLASH = "kept boolean, spans string, start long, host string, rule string, part int, text_sha256 string, lp string, key string, n_tokens long"
BASIC = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, None), (None, "only a text"), (2, ""), (3, " \n\t "), (3, " \n\t "), (4, "Alpha Beta c d e f"), (5, "alpha beta C D E F"), (6, LONG),
    (7, "日本語 é \U0001f600 mixed   text\r\n\x0b end "), (8, "0" * 30_000), (9, "short"), (10, "short"), (11, "write to jo.doe_1@mail.example.com or +1 (743) 555-3824, 10.0.0.255, 4111 1111 1111 1111"),
    (12, None), (None, "only a text"), (13, "a b c d"), (14, "a b c d"), (-5, "minus"), (2**62, "large id"),
]


def documents(spark, rows=ROWS, clash=True):
    data = [(i, t, "en", "src0", len(t or "")) + ((True, "x", 1, "h", "r", 2, "s", "l", "k", 3) if clash else ()) for i, t in rows]
    return spark.createDataFrame(data, f"{BASIC}, {CLASH}" if clash else BASIC)


def nothing(spark):
    return documents(spark, [])
