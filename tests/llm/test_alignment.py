import hashlib
import random
from collections import Counter

import pytest

from readloom.llm import alignment
from readloom.llm.common import table
from readloom.llm.queries import op12_alignment, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
LETTERS = list("ab é.,'\n\t  \r\x1c\x00\x85 　日本😀_x1") + ["<|endoftext|>", "<s>", "<0x41>", "word ", "  ", " the", "'s"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(libraries, text):
    """[(A ids, B ids)] of a text by the libraries on the whole text, None without tokens."""
    a, b = libraries
    if not text:
        return None
    want, letters = (" " + text).encode(), alignment.byte_letters()
    ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
    pieces = [b.id_to_piece(i) for i in ids[1]]
    parts = (
        [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
        [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces, strict=True)],
    )
    if any(b"".join(p) != want for p in parts):
        return None
    ends = []
    for side in parts:
        at = [0]
        for piece in side:
            at.append(at[-1] + len(piece))
        ends.append(at[1:])
    out, start = [], [0, 0]
    places = [{end: i + 1 for i, end in enumerate(e)} for e in ends]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        stop = [at[cut] for at in places]
        out.append((ids[0][start[0] : stop[0]], ids[1][start[1] : stop[1]]))
        start = stop
    return out


def brute(libraries, rows):
    made = [brute_groups(libraries, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in made]
    held, most = Counter(p for of in links for p in of), Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), groups, of in zip(rows, made, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])
        out.append((
            doc_id, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []),
            sum(of.values()), sum(n for p, n in of.items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in of.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def made(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=str)


def made_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return made(alignment.align(docs, A, B, digest=True).withColumnRenamed("groups", "groups_sha256"))


def test_query(spark, libraries):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert made(op12_alignment(spark, "/root/testdata/sf0.001")) == brute(libraries, rows)


def test_odd_texts(spark, libraries):
    rng = random.Random(9)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [None, "", " ", "   ", "a ", " a", "▁", "a▁b c", "x" * 5000, "😀" * 300, "=" * 3000 + "\n" * 70]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    assert made_of(spark, rows + rows[:30]) == brute(libraries, rows + rows[:30])  # repeats


def test_full_memory_and_many_blocks(spark, libraries, monkeypatch):
    rng = random.Random(10)
    known = alignment.Words(alignment._known(*_files()).pair)
    monkeypatch.setattr(alignment, "MOST_WORDS", 40)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(20)) for _ in range(200)]
    pairs = Counter()
    for i in range(0, 200, 7):
        _, held = alignment._block(known, list(range(7)), texts[i : i + 7], False)
        pairs.update(dict(zip(held.pairs[0].tolist(), held.times[0].tolist(), strict=True)))
    want = Counter(x << 15 | y for t in texts for x, y in {(x, y) for a, b in brute_groups(libraries, t) for x in a for y in b})
    assert pairs == want and len(known) <= 140


def _files():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return a.read(), b.read()


def test_long_text(spark, libraries):
    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(20_000))
    assert made_of(spark, [(1, text), (2, "w1")]) == brute_long(libraries, text)


def brute_long(libraries, text):
    """Counts of two documents of which the second is a word of the first."""
    groups = [g for w in text.split(" ") for g in brute_groups(libraries, w)]
    links = Counter((x, y) for a, b in groups for x in a for y in b)
    small = Counter((x, y) for a, b in brute_groups(libraries, "w1") for x in a for y in b)
    held, most = Counter([*links, *small]), Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, (of, gs) in enumerate([(links, groups), (small, brute_groups(libraries, "w1"))]):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((
            i + 1, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(of.values()),
            sum(n for p, n in of.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in of.items()),
            hashlib.sha256(line.encode()).hexdigest(),
        ))
    return out


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).count() == 0
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, block long, pairs string")
    row = alignment.align(docs, A, B).collect()[0]
    assert (row.n_groups, row.groups) == (2, "257|264;275|287")
