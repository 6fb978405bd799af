import base64
import hashlib
import random

import pyarrow.fs as pafs
import pytest

from otindex.llm.files import manifest
from otindex.llm.warc import read_warc, write_warc
from otindex.session import working_folder

SCHEMA = "page_id bigint, url string, html string, digest string, task int"


def pages():
    rng = random.Random(1)
    bodies = [None, "", "a", "<p>é 北京</p>\r\n\r\nx", "WARC/1.1\r\n\r\n", "long " * 20000, "twin"]
    rows = [(i, f"http://h/{i}?%0A\r\né", bodies[rng.randrange(7)] if i % 3 else f"own {i}", "clash", i) for i in range(120)]
    return [*rows, rows[5], (119, None, "twin", None, None), (119, None, "twin", None, None), (None, "u", "twin", None, None), (None, None, "lone", None, None), (None, "v", "lone", None, None)]


def brute(rows, least):
    out, groups = [], {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda x: (x is not None, x or 0))
        for k, page_id in enumerate(ids):
            last = k == len(ids) - 1
            response = last or len(payload) < least
            out.append((page_id, len(payload), digest, "response" if response else "revisit", None if response else ids[-1]))
    return sorted(map(str, out))


@pytest.mark.parametrize(("least", "file_bytes"), [(0, 1 << 28), (2, 2000)])
def test_round_trip(spark, least, file_bytes):
    rows = pages()
    folder = working_folder(spark, "warc")
    written = write_warc(spark.createDataFrame(rows, SCHEMA), folder, least, file_bytes).collect()
    assert sum(r["records"] for r in written) == len(rows)
    assert (len(written) > 8) == (file_bytes < 10_000)
    out = read_warc(spark, folder).collect()
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(map(str, found)) == brute(rows, least)
    assert sorted(str((r["page_id"], r["url"])) for r in out) == sorted(str(r[:2]) for r in rows)
    payloads = {(r[2] or "").encode() for r in rows}
    assert {bytes(r["payload"]) for r in out if r["record_type"] == "response"} == payloads
    store, path = pafs.FileSystem.from_uri(folder)
    names = {f.base_name for f in store.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.endswith("gz")}
    assert names == {r["name"] for r in manifest(spark, folder).collect()}


def test_the_same_pages_make_the_same_bytes(spark):
    digests = []
    for _ in range(2):
        folder = working_folder(spark, "warc")
        write_warc(spark.createDataFrame(pages(), SCHEMA), folder, 0, 5000)
        store, path = pafs.FileSystem.from_uri(folder)
        digests.append({r["name"]: hashlib.sha1(store.open_input_stream(f"{path}/{r['name']}", compression=None).read()).hexdigest() for r in manifest(spark, folder).collect()})
    assert digests[0] == digests[1]


def test_damage_is_noticed(spark):
    folder = working_folder(spark, "warc")
    name = write_warc(spark.createDataFrame([(1, "u", "text " * 50, "", 0)], SCHEMA), folder).first()["name"]
    store, path = pafs.FileSystem.from_uri(folder)
    data = bytearray(store.open_input_stream(f"{path}/{name}", compression=None).read())
    data[-40] ^= 255
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="(?i)damaged|invalid|CRC|Error"):
        read_warc(spark, folder).collect()


def test_empty_table(spark):
    folder = working_folder(spark, "warc")
    write_warc(spark.createDataFrame([], SCHEMA), folder)
    assert read_warc(spark, folder).count() == 0
