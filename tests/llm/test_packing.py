import functools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from barquet.llm import packing as K

TEXTS = [None, "", "plain words", " lead and  double  ", "naïve café 日本語 😀‍👩", "<|endoftext|> as text", "in<|endoftext|> <|endoftext|>\n<|endoftext |>", "tabs\t\tand\n\n\nlines   \n", "x" * 5000, "word " * 9000, " " * 3000, "\r\n\x00\x1f", "1234567890 " * 300, "don't we'll I'VE"]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(K.vocabulary_path(K.VOCABULARY))


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, K.END]


def test_pieces_and_windows(spark):
    rows = [(k, t, 0) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0), (None, "no id", 0)]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for k, text in enumerate(TEXTS):
        ids = ids_of(text)
        own = sorted(pieces[k], key=lambda r: r.start)
        if k == 2:
            own = own[::2]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= K.WINDOW


def test_fast_ids_are_the_tokenizers_ids():
    r = random.Random(0)
    encode = K.Encoder(K.vocabulary_path)
    for _ in range(300):
        text = "".join(r.choice("aé日😀 \n\t'sSt!?.-_0٣İß​") if r.random() < 0.8 else chr(r.randint(0x20, 0x2FFF)) for _ in range(r.randint(1, 60)))
        assert list(encode(text)) == ids_of(text)[:-1]


def test_a_special_token_in_the_text_is_one_id():
    encode = K.Encoder(K.vocabulary_path)
    assert list(encode("a<|endoftext|>b")) == encode.exact("a<|endoftext|>b") == tokenizer().encode("a<|endoftext|>b", add_special_tokens=False).ids
    assert 50256 in encode("a<|endoftext|>b")
    assert list(encode("<|endoftext|>" + " " * 300_000)) == ids_of("<|endoftext|>" + " " * 300_000)[:-1]


def test_full_windows_need_no_packing_task(spark):
    got = K.pack(spark.createDataFrame([(1, "word " * 9000), (2, "word " * 9000)], "doc_id long, text string")).collect()
    full = [r for r in got if r.length == K.WINDOW]
    assert len({r.sequence_id for r in full}) == len(full) == 8 and all(r.sequence_id >= 1 << 62 for r in full)


def test_best_fit_takes_the_tightest_window():
    r = random.Random(1)
    lengths = np.array([r.randint(1, 100) for _ in range(500)])
    place, offset = K.best_fit_decreasing(lengths, 100)
    rooms, at = [], {}
    for k in np.argsort(-lengths, kind="stable"):
        fit = [x for x in rooms if x >= lengths[k]]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - lengths[k])
        else:
            rooms.append(100 - lengths[k])
        at[place[k]] = at.get(place[k], 0) + lengths[k]
    assert sorted(rooms) == sorted(100 - x for x in at.values())


def test_little_padding(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(int(r.expovariate(1 / 400))))) for k in range(3000)]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string"))
    used, windows = got.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used / (windows * K.WINDOW) > 0.99


def test_empty_table(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
