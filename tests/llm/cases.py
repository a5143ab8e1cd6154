"""Documents that every text operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from random import Random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "kept boolean, component_id string, digest int, content int, score string, predicted string, slot string, shard int, ids int, n int, key string"
)
ALPHABET = [*"aAeEzZéÉßÀ÷×0129.,;:!?'\"<>|-_ \n\t\r\x0b\x0c\x1c\x85\xa0　̸́ςΣİſªº²½中日​ ▁"]
PIECES = ["  ", "   ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<s>", "</s>", "<0x0A>", "aaaaaaa", "the", " and"]


def odd_texts(n=400, seed=1):
    random = Random(seed)
    made = ["".join(random.choice(ALPHABET + PIECES) for _ in range(random.randrange(50))) for _ in range(n)]
    return [*made, "", " ", "  x", "x  ", "\n", "z" * 3001, "ab" * 2000, "a b c d"]


def rows():
    random = Random(2)
    words = ["".join(random.choice("aehinorst") for _ in range(random.randrange(1, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = [sentence(random.randrange(1, 120)) for _ in range(60)]
    hot = sentence(80)
    texts = base + base[:10] + [t.upper() for t in base[10:15]] + [hot] * 60 + [hot + " more"] * 3
    texts += [None, None, "", "", "   ", "\t\n", sentence(60_000), "x" * 50_000, *odd_texts(20)]
    made = [(i, t) for i, t in enumerate(texts)]
    made += [made[3], made[3], (None, hot), (None, None), (None, "alone without a number")]
    return made


def frame(spark, made=None):
    clash = (True, "c", 1, 2, "s", "p", "slot", 3, 4, 5, "k")
    made = rows() if made is None else made
    return spark.createDataFrame([(i, t, "en", "s", 0, *clash) for i, t in made], SCHEMA).repartition(5)
