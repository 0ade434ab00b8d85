"""WARC archives and URL filters."""

import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import pyarrow.fs
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import CLASHES, PAGES, sentence

from tallyframe.llm import urls, warc
from tallyframe.session import materialize


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", *(f"'x' AS {c}" for c in CLASHES if c != "html_"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    hot = "<p>" + "hot page " * 200 + "</p>"
    rows = [(i, f"https://h{i % 7}.example.org/p/{i}", hot if i % 3 == 0 else f"<p>{sentence(rng, n=rng.randint(1, 400))}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "no scheme", ""), (102, "http://a/b c\r\nX: y", "short"), (103, "http://a", "short"), (None, "http://n", hot), (104, "http://l", "é" * 300_000)]
    return rows + [rows[1], (106, "http://d1", "d" * 2000), (106, "http://d2", "d" * 2000)]


def test_round_trip(spark, rows, tmp_path):
    folder = str(tmp_path / "warc")
    index = materialize(warc.write_archives(pages_of(spark, rows), folder, frame_bytes=4000, bundle_bytes=9000, salts=3), "warc-test")
    got = warc.read_archives(spark, folder, index).collect()
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    digest = lambda b: hashlib.sha1(b).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((None if i is None else str(i), len(p := (h or "").encode()), digest(p)) for i, _, h in rows)
    of = {digest(k): (k, v) for k, v in groups.items()}
    for key, (payload, ids) in of.items():
        mine = [r for r in got if r.payload_digest == key]
        responses = [r for r in mine if r.record_type == "response"]
        if len(payload) < 1000 or len(ids) == 1:
            assert len(responses) == len(mine) and all(r.refers_to is None for r in mine)
        else:
            last = str(max(i for i in ids if i is not None))
            assert [r.page_id for r in responses] == [last]
            assert all(r.refers_to == last for r in mine if r.record_type == "revisit")
    # every record again, by its place in the index alone
    again = warc.lookup(index, folder).collect()
    assert Counter(again) == Counter(got)
    one = index.where("page = 7")
    assert [r.page_id for r in warc.lookup(one, folder).collect()] == ["7"]


def test_bundles_are_plain_zstandard(spark, rows, tmp_path):
    """A reader that knows nothing of the seek table reads the records in order."""
    import zstandard

    folder = str(tmp_path / "warc")
    index = materialize(warc.write_archives(pages_of(spark, rows[:20]).coalesce(1), folder, frame_bytes=4000), "warc-test").collect()
    files = pyarrow.fs.LocalFileSystem()
    raw = files.open_input_file(f"{folder}/{index[0].bundle}").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert [f["WARC-Record-ID"] for f, _, _ in warc.parse(plain)] == [r.record_id for r in index]
    assert max(r.frame for r in index) > 0


def test_no_pages(spark, tmp_path):
    index = materialize(warc.write_archives(pages_of(spark, []), str(tmp_path / "none")), "warc-test")
    assert warc.read_archives(spark, str(tmp_path / "none"), index).collect() == []
    assert urls.judge(spark, pages_of(spark, [])).collect() == []


def fit_by_hand(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_rules_and_classifier(spark):
    rng = random.Random(5)
    text = "<p>" + " ".join(["spam"] * 30 + ["farm"] * 30 + ["news"] * 20 + ["paper"] * 20 + ["the"] * 50) + "</p>"
    given = [None, "", "plain", "http://", "HTTP://WWW.Example.NET/en/x?q=/de/", "http://net", "http://net/", "x://xnet/", "a://b://c/d", "http://example.com/de/1", "http://example.com:80/de/", "http://É.org/fr/#a?b", "http://org?x=/fr/"]
    rows = [(i, u, None) for i, u in enumerate(given)]
    rows += [(100 + i, f"http://spamfarm{rng.choice(['', '2'])}.net/deals/{i}", text) for i in range(30)]
    rows += [(200 + i, f"http://newspaper.org/fr/{i}", text) for i in range(30)]
    rows += [(300, "http://spamfarm.info/deals/1", None), (301, "http://newspaper.info/fr/2", None), (None, "http://newspaper.info/fr/2", None), rows[5]]
    got = urls.judge(spark, pages_of(spark, rows), salts=3).collect()
    assert len(got) == len(rows)
    url = {i: u for i, u, _ in rows}
    for r in got:
        host, path, rule = fit_by_hand(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == (rule.verdict if rule else "block" if r.odds > 0 else "allow")
    of = {r.page_id: r for r in got}
    assert of[300].words[:2] == ["spam", "farm"] and of[300].verdict == "block"
    assert of[301].words[:2] == ["news", "paper"] and of[301].verdict == of[None].verdict == "allow"


def test_viterbi_takes_the_likeliest_cut():
    logs = {w: math.log(p) for w, p in {"a": 0.2, "ab": 0.3, "b": 0.1, "c": 0.2, "bc": 0.01}.items()}
    assert urls.viterbi("abc", logs, math.log(1e-6)) == ["ab", "c"]
    assert urls.viterbi("", logs, -1.0) == []
    assert "".join(urls.viterbi("x" * 500, {}, -5.0)) == "x" * 500


def test_words_of_any_script_and_length(spark):
    long, longer = "donaudampfschifffahrtsgesellschaft", "x" * 70 + "y"
    text = " ".join(["société"] * 30 + ["новости"] * 30 + ["мира"] * 30 + [long] * 20 + [longer] * 20 + ["haus"] * 20)
    pages = pages_of(spark, [(1, "http://новостимира.example/", f"<p>{text}</p>"), (2, "http://SOCIÉTÉhaus.example/", None), (3, f"http://haus{long}.example/", None), (4, f"http://{longer}.example/", None)])
    counts = {r.word: r.n for r in urls.word_counts(pages).collect()}
    assert counts == {"société": 30, "новости": 30, "мира": 30, long: 20, longer: 20, "haus": 20}
    of = {r.page_id: r.words for r in urls.judge(spark, pages, salts=3).collect()}
    assert of[1][:2] == ["новости", "мира"] and of[2][:2] == ["société", "haus"]
    assert of[3][:2] == ["haus", long] and of[4][0] == longer
