import random

from helpers import docs, store

from tidemark.llm import tokens as T


def brute(text, pieces):
    """Viterbi over all pieces of a whole text, left to right; the longer piece wins a tie."""
    if not text:
        return 0
    scores = dict(pieces)
    unknown = min(scores.values()) - 10.0
    text = text.replace(" ", T.BLANK)
    text = text if text.startswith(T.BLANK) else T.BLANK + text
    total = 0
    for segment in _segments(text):
        n, longest = len(segment), max(map(len, scores))
        best = [None] * (n + 1)
        best[0] = (0.0, 0)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = segment[start:end]
                if piece in scores:
                    option = (best[start][0] + scores[piece], best[start][1] + 1)
                    if best[end] is None or option[0] > best[end][0]:
                        best[end] = option
            if segment[end - 1] not in scores:
                option = (best[end - 1][0] + unknown, best[end - 1][1] + len(segment[end - 1].encode()))
                if best[end] is None or option[0] > best[end][0]:
                    best[end] = option
        total += best[n][1]
    return total


def _segments(text):
    cuts = [i for i, c in enumerate(text) if c == T.BLANK] + [len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


SMALL = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("▁ab", -3.5), ("ba", -1.5), ("aab", -3.0)]


def test_ties_and_unknown_characters():
    rnd = random.Random(2)
    counts = T.SegmentCounts(SMALL)
    for text in ["", None, " ", "  ", "a", "ab ab", "é", "aéb", "▁a", " ▁ab", "日本 a", *("".join(rnd.choices("ab cé", k=rnd.randint(1, 30))) for _ in range(400))]:
        assert counts.tokens(text) == brute(text, SMALL), repr(text)


def test_same_as_the_tokenizers_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = T.vocabulary()
    # The library spells unknown characters by byte pieces, as the file's own do.
    spelt = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *spelt], unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.BLANK, prepend_scheme="always")
    counts = T.SegmentCounts(pieces)
    rnd = random.Random(4)
    letters = "etaoinshrdlucmfwypéß漢🙂\n"
    for _ in range(300):
        text = " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 12)))
        assert counts.tokens(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_control_and_byte_pieces_never_match():
    pieces = dict(T.vocabulary())
    assert not {"<unk>", "<s>", "</s>", "<0x0A>"} & set(pieces) and len(pieces) > 30_000
    counts = T.SegmentCounts(T.vocabulary())
    assert counts.tokens("<s>") > 1 and counts.tokens("<0x0A>") > 1


def test_query(spark, tmp_path, sf_dir):
    pieces = T.vocabulary()
    texts = [None, "", " ", "word", "word word", "  two  blanks ", "naïve café 漢字 🙂", "line\nbreak\ttab", "x" * 3000, "word"]
    got = {r.doc_id: r.n_tokens for r in T.op7(spark, store(tmp_path, documents=docs(spark, texts))).collect()}
    assert got == {i: brute(t, pieces) for i, t in enumerate(texts)}
    sample = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("n_chars").limit(60).collect()
    counted = {r.doc_id: r.n_tokens for r in T.op7(spark, sf_dir).collect()}
    assert all(counted[r.doc_id] == brute(r.text, pieces) for r in sample)
    assert T.op7(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0
