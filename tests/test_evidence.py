"""The evidence source on answers in a local folder, read as a batch and as a stream."""

import json

from sieveline.sources import evidence as E

QUERIES = [("soto", "soto/ayam ?"), ("rice", "nasi"), ("rice", "none")]


def answers(root, round_, **by_query):
    import urllib.parse

    for query, found in by_query.items():
        folder = root / f"round={round_}" / f"query={urllib.parse.quote({'a': QUERIES[0][1], 'b': QUERIES[1][1]}[query], safe='')}"
        folder.mkdir(parents=True)
        (folder / "part.json").write_text("\n".join(json.dumps(f) for f in found))


def test_batches_and_streams_read_the_same_answers(spark, tmp_path):
    root = tmp_path / "answers"
    at = "2025-01-01T00:00:00+00:00"
    page = lambda rank, title, url: {"rank": rank, "title": title, "snippet": None, "url": url, "collected_at_utc": at}
    answers(root, 0, a=[page(2, "Two", "https://www.x.org/2"), page(1, "One", "https://m.X.org/1")], b=[page(1, "One", "https://m.X.org/1"), page(2, "B", "not a url")])
    got = E.collect_evidence(spark, QUERIES, path=f"file://{root}").collect()
    rows = {(r.food_class, r.query, r.round, r.rank, r.title, r.domain, r.collected_at_utc) for r in got}
    # the answer that two queries share stays with the first of them
    assert rows == {("rice", "nasi", 0, 1, "One", "x.org", at), ("rice", "nasi", 0, 2, "B", "", at), ("soto", "soto/ayam ?", 0, 2, "Two", "x.org", at)}
    assert E.collect_evidence(spark, QUERIES, path=f"file://{tmp_path}/nothing").count() == 0

    seen = []

    def step():
        stream = E.stream_evidence(spark, QUERIES, path=f"file://{root}", partitions="2")
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend((r.query, r.round, r.rank) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        found = sorted(seen)
        seen.clear()
        return found

    first = [("nasi", 0, 1), ("nasi", 0, 2), ("soto/ayam ?", 0, 1), ("soto/ayam ?", 0, 2)]
    assert step() == first and step() == []
    answers(root, 1, b=[page(1, "New", "https://amp.y.org/")])
    answers(root, 3, b=[page(1, "Too early", "https://y.org/")])  # round 2 isn't there yet
    assert step() == [("nasi", 1, 1)]
    assert len(E.EvidenceReader({"queries": json.dumps(QUERIES), "path": f"file://{root}", "partitions": "4"}).partitions()) == 4
