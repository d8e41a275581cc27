import glob
import hashlib
import io

import pytest
import zstandard

from barspark.llm import warc

BIG = "<p>é" * 500


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


ROWS = [(1, "http://a/ b\n", BIG, "x"), (3, None, BIG, None), (2, "http://c", BIG, "x"), (4, "http://d", "short", ""), (5, "http://d", "short", ""), (6, "", None, ""),
        (None, "http://n", BIG + "!", ""), (None, "http://n", BIG + "!", ""), (7, "http://long", "x\r\n\r\n" * 200_000, ""), (8, "u", "", "")]


def test_round_trip(spark, tmp_path):
    manifest = warc.write(frame(spark, ROWS).repartition(2), f"file://{tmp_path}/w", frame_bytes=4000)
    got = warc.read(manifest).collect()
    assert len(got) == len(ROWS)
    best = {p: max((i for i, _, h, _ in ROWS if h == p and i is not None), default=None) for _, _, p, _ in ROWS}
    for pid, _, html, _ in ROWS:
        if pid is None:
            continue
        raw = (html or "").encode()
        r = next(r for r in got if r.page_id == pid)
        dup = len(raw) >= 1000 and best[html] != pid
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (
            len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if dup else "response", best[html] if dup else None)
        assert r.payload == (None if dup else raw)
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]


def test_bundles_are_zstandard_and_seekable(spark, tmp_path):
    warc.write(frame(spark, ROWS).coalesce(1), f"file://{tmp_path}/w", frame_bytes=3000)
    (path,) = glob.glob(f"{tmp_path}/w/*.warc.zst")
    reader = warc.Reader(f"file://{path}")
    assert len(reader.index) == len(ROWS) and len({k for _, k, _, _ in reader.index}) > 2
    # any decoder reads the frames as one stream of records, in order
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert plain == b"".join(reader.records())
    for row, *_ in reader.index:
        fields, payload = warc.parse(reader.fetch(row))
        assert fields["WARC-Record-ID"] == f"<urn:x-page-row:{row}>"
    with pytest.raises(KeyError):
        reader.fetch(-5)


def test_no_rows(spark, tmp_path):
    assert warc.read(warc.write(frame(spark, ROWS).limit(0), f"file://{tmp_path}/w")).count() == 0


def test_query_matches_sql(spark):
    from barspark.llm.queries import ORACLES, QUERIES
    from tests.oracle import compare, duck

    sf = "/root/testdata/sf0.01"
    for name in sorted(set(ORACLES)):
        df = QUERIES[name](spark, sf)
        cur = duck(sf).execute(ORACLES[name])
        assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None, name
