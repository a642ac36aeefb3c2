import hashlib
import tarfile
import zlib

from barquet.llm import common, media


def test_round_trip(spark):
    texts = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é" * 1000, "long " * 50_000]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(100, "a", 1), (None, "a", 1), (2, "a", 1)]
    folder = common.shared_dir(spark) + "/media"
    got = media.with_media(spark.createDataFrame(rows, "doc_id long, text string, width int"), folder).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, text in enumerate(texts):
        b = (text or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.width, r.height, r.depth) == (64, len(p) // 64, 8)
        with open(f"{folder.removeprefix('file://')}/{r.shard}", "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and media.decode(stored) == p
        with tarfile.open(f"{folder.removeprefix('file://')}/{r.shard}") as tar:
            assert f"{r.digest}.png" in tar.getnames()
    assert {(r.digest, r.shard, r.offset, r.feature) for r in got if r.n_bytes == 1} == {(by[2].digest, by[2].shard, by[2].offset, by[2].feature)}
    assert by[0].feature == by[1].feature


def test_headers_alone(spark):
    folder = common.shared_dir(spark) + "/media"
    stored = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), folder)
    row = media.read_columns(media.media_table(stored), folder, samples=False).first()
    assert (row.width, row.height, row.depth) == (64, 1, 8) and "feature" not in row


def test_empty_table(spark):
    assert media.with_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
