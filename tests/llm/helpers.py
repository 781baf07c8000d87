"""Small corpora with the cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, node int, spans string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ba", "da", "fe", "gu", "ho", "ji", "ly", "mo", "x", "z")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, size=60):
    """(doc_id, text): fresh prose, near copies, copies, a shared passage, periodic text, null, empty, blank, one long text, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(size)]
    passage = prose(rng, 45)
    for k in range(6):
        w = passage.split() + prose(rng, 60).split() if k % 2 else prose(rng, 60).split() + passage.split()
        rows.append((100 + k, " ".join(w)))
    base = prose(rng, 100).split()
    for k in range(8):
        w = list(base)
        w[rng.randrange(100)] = "edit%d" % k
        rows.append((200 + k, " ".join(w)))
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, "again and " * 80), (303, "again and " * 70), (304, None), (305, ""), (306, " \t\n "), (307, "Öl ñandú 漢字 " * 30), (308, prose(rng, 3000)), (308, None)]
    rows += [(309, "twice " + prose(rng, 50))] * 2
    rows += [(None, prose(rng, 40)), (310, "one"), (311, "one")]
    return rows


def frame(spark, rows):
    """rows as a documents table with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), "x", 1, "y") for i, t in rows], DOCS).repartition(4)


def empty(spark):
    return spark.createDataFrame([], DOCS)
