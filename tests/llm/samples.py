"""Small tables with the hard cases: nulls, empty and long texts, repeated rows, clashing columns."""
import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, k string, node string, "
          "fp string, shard string, component_id string, p string, q string, blk string, piece string, failed string")
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("dar", "fen", "gil", "hom", "jur", "vax")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def edge_texts() -> list:
    base = prose(1, 300)
    return [None, "", "   \t\n ", "one", "one two", "one two three", "Élan über São—naïve ßtraße", base, base, base,
            base.replace("dar", "DAR"), base + " tail", prose(2, 5000), "x" * 20000, "a\n\na\n\nb\r\na \n a",
            "it's  we're\n\n \t don't 3.14, ½ × 2   漢字 \U0001F600 <|endoftext|> end", prose(3, 60) + "\n" + prose(3, 60),
            "### $$$ | | | <a> &amp;", "spam spam spam " * 100]


def edge_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(edge_texts())]
    rows += [rows[7], rows[7], rows[0], (None, "a text without an id", "en", "src1", 20), (None, None, None, None, None), (-5, prose(1, 300), "en", "src1", 1)]
    return spark.createDataFrame([r + ("x",) * 11 for r in rows], SCHEMA)
