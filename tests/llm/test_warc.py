"""WARC archives: exact round trip, revisits, rolling, and files that don't depend on partitions."""

import gzip
import hashlib
import os
import random
from collections import Counter

from fleetspan.llm.common import new_folder
from fleetspan.llm.warc import archive_round_trip, parse_record, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, record_type string, shard int"


def pages():
    draw = random.Random(8)
    big = ["x" * 1000, "é" * 600, "y" * 5000]
    rows = [(i * 7 - 30, f"http://h{i % 5}.example/{i}", draw.choice([*big, f"<p>{i}</p>", "<b>same small</b>", None, "", "z" * 999])) for i in range(120)]
    return rows + [(None, None, big[0]), (None, "http://n.example/a b\r\nX: y", "null id"), (5000, "u", big[2]), (5000, "v", big[2]), (5000, "v", big[2])]


def expected(rows):
    largest = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 1000 and page_id is not None:
            largest[html] = max(largest.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = largest.get(html) if len(data) >= 1000 else None
        to = None if to == page_id else to
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return Counter(out)


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)


def test_round_trip(spark):
    found = archive_round_trip(frame(spark, pages(), 3), records_per_shard=40, roll_bytes=3000).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)
    assert got == expected(pages())


def test_files_depend_on_pages_alone(spark):
    made = []
    for parts, shuffles in ((1, "2"), (7, "5")):
        folder = new_folder(spark, "warc-test")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        manifest = write_warc(frame(spark, pages(), parts), folder, roll_bytes=3000, records_per_shard=50).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        path = folder.removeprefix("file://").removeprefix("file:")
        for row in manifest:
            with open(f"{path}/{row['name']}", "rb") as file:
                data = file.read()
            assert hashlib.sha1(data).hexdigest() == row["sha1"] and len(data) == row["bytes"]
        assert not os.listdir(f"{path}/temporary")
        made.append(sorted((r["shard"], r["seq"], r["name"], r["bytes"], r["records"], r["sha1"]) for r in manifest))
    assert made[0] == made[1] and max(row[1] for row in made[0]) > 0
    with gzip.open(f"{path}/{made[1][0][2]}") as archive:
        head, _ = parse_record(archive.read().split(b"\r\n\r\nWARC/1.1\r\n")[0])
    assert head["WARC-Type"] == "warcinfo" and head["WARC-Filename"] == made[1][0][2]


def test_empty_table(spark):
    folder = new_folder(spark, "warc-test")
    assert write_warc(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert read_warc(spark, folder).count() == 0
