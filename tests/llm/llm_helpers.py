"""Odd documents and plain functions that several test modules share."""

SF = "/root/testdata/sf0.001"

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, "ÀÉß ſtraße Kelvin K ſ 𝔘𝔫𝔦 😀😀 é"),
    (7, "same text said twice, word for word, long enough to count as a passage of its own."),
    (8, "same text said twice, word for word, long enough to count as a passage of its own."),
    (9, "x" * 70_000), (10, "0123456789 " * 5_000), (11, "token=" * 2_000), (12, "a.b@" * 3_000),
    (13, "before the line. same text said twice, word for word, long enough to count as a passage of its own. after it"),
    (14, " \r\n\x0b\x0c mixed   spaces here too \x1c\x85 end  "), (14, "a second row of one id"), (14, "a second row of one id"),
    (None, "a row without an id"), (-5, "negative id it's they're we'll I'd 'S"), (20, "<|endoftext|> <|im_start|> plain text"),
]

ODD_TEXTS = [(i, t or "") for i, t in ODD]


def texts_of(df):
    return [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()] if "Text" not in df.columns else ODD_TEXTS
