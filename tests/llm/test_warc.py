"""Archives: an exact round trip, equal bytes for equal tables, and a commit that survives repeats."""

import gzip
import hashlib
from pathlib import Path

import pytest

from vacantia.llm import warc

LONG = "<p>" + "x" * 200 + "é</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a/{i}", f"<html>{i % 40} {'word ' * (i % 97)}</html>", "t", "d") for i in range(400)]
    rows += [(900, None, None, "t", "d"), (901, "u\r\nX: y", "", "t", "d"), (902, "u", LONG, "t", "d"), (903, "v", LONG, "t", "d"),
             (902, "w", LONG, "t", "d"), (None, "n", LONG, "t", "d"), (None, "n", "alone " * 40, "t", "d"),
             (905, "u", "Z" * 300_000, "t", "d"), (906, "u", "tiny", "t", "d"), (907, "u", "tiny", "t", "d"),
             (908, "u", "h\r\n\r\nWARC/1.1\r\n" * 20, "t", "d")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string, digest string").repartition(5)


def want(rows):
    first = {}
    for r in rows:
        body = (r.html or "").encode()
        if r.page_id is not None and len(body) >= 100:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        other = first.get(body)
        revisit = other is not None and other != r.page_id
        out.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response",
                    other if revisit else None, None if revisit else body))
    return sorted(out, key=repr)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, shard_bytes=60_000, roll_bytes=4000)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None)
            for r in warc.read(spark, folder).collect()]
    assert sorted(rows, key=repr) == want(pages.collect())
    files = {r.name: r for r in manifest.collect()}
    assert len({r.shard for r in files.values()}) > 3 and max(r.number for r in files.values()) > 0
    names = sorted(p.name for p in Path(tmp_path, "a").glob("*.warc.gz"))
    assert names == sorted(files) and not Path(tmp_path, "a", "_temporary").exists()
    keys = []
    for name in names:
        data = Path(tmp_path, "a", name).read_bytes()
        assert hashlib.sha256(data).hexdigest() == files[name].sha256 and gzip.decompress(data)
        keys += [int(h["Page-Id"]) if "Page-Id" in h else -1 for h, _ in map(warc.parse, warc.members(data)) if h["WARC-Type"] != "warcinfo"]
    assert keys == sorted(keys)


def test_equal_tables_give_equal_files(spark, pages, tmp_path):
    hashes = []
    for name, frame in (("b", pages), ("c", pages.repartition(2))):
        warc.write(frame, f"file://{tmp_path}/{name}", shard_bytes=60_000, roll_bytes=9000)
        hashes.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(tmp_path, name).glob("*.warc.gz")})
    assert hashes[0] == hashes[1] and len(hashes[0]) > 3


def test_strays_are_not_read_and_moves_repeat(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/d"
    manifest = warc.write(pages.limit(5), folder)
    Path(tmp_path, "d", "stray.warc.gz").write_bytes(b"junk")
    assert warc.read(spark, folder).count() == 5
    again = manifest.selectExpr("*", "'gone' AS temporary")
    assert warc._moved(again, folder).count() == manifest.count()


def test_files_that_differ_from_the_manifest_fail(spark, pages, tmp_path):
    for name in ("f", "g", "h", "i"):
        manifest = warc.write(pages.limit(5), f"file://{tmp_path}/{name}")
    (file,) = [r.name for r in manifest.collect()]
    data = Path(tmp_path, "f", file).read_bytes()
    Path(tmp_path, "f", file).write_bytes(data + b"x")
    with pytest.raises(ValueError, match="bytes for"):
        warc.read(spark, f"file://{tmp_path}/f")
    Path(tmp_path, "g", file).unlink()
    with pytest.raises(ValueError, match="missing"):
        warc.read(spark, f"file://{tmp_path}/g")
    # the modification time of a gzip header is in no checksum of its own
    Path(tmp_path, "h", file).write_bytes(data[:4] + bytes([data[4] ^ 1]) + data[5:])
    with pytest.raises(Exception, match="digest in the manifest"):
        warc.read(spark, f"file://{tmp_path}/h").collect()
    rows = manifest.withColumn("records", manifest.records + 1).collect()
    spark.createDataFrame(rows, manifest.schema).write.mode("overwrite").parquet(f"file://{tmp_path}/i/manifest")
    with pytest.raises(Exception, match="records and not"):
        warc.read(spark, f"file://{tmp_path}/i").collect()


def test_empty_table_and_damage(spark, pages, tmp_path):
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
    member = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), 4, None, 0, warc.DATE)
    (plain,) = warc.members(member)
    with pytest.raises(ValueError):
        warc.parse(plain.replace(b"body", b"dody"))
    with pytest.raises(ValueError):
        list(warc.members(member[:-9]))
