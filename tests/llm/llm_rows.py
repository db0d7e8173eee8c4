"""Rows with the cases that every operator defines."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# null and empty texts, blanks only, ties, repeated rows and ids, null columns, other scripts, a very long text
LONG = " ".join(f"w{i % 4999}x{i % 7}" for i in range(60_000))
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "en", "b", 4), (5, "word", "en", "b", 4),
    (6, LONG, "en", "a", len(LONG)), (7, LONG, "en", "c", len(LONG)), (8, "x " + LONG, "en", "a", 1),
    (9, "żółw 漢字 🙂 naïve\nżółw 漢字 🙂 naïve\n\n don't 's 12,5", "fr", "a", 1),
    (9, "żółw 漢字 🙂 naïve\nżółw 漢字 🙂 naïve\n\n don't 's 12,5", "fr", "a", 1),
    (10, "same id one", "en", "a", 1), (10, "same id two", "de", "b", 1), (None, "no id here at all", "en", "a", 1),
    (None, None, None, None, None), (11, "a" * 50_000, "en", "a", 50_000), (-5, "negative id", "en", "d", 1),
]
