"""The HTTP model client and the command line, without any network."""

import io
import pickle
import urllib.error

import pytest

from foliograph.__main__ import parser, run
from foliograph.operators.models import ContextOverflow
from foliograph.sources.http_model import EmbeddingUnavailable, HttpModel


def fail(code):
    return urllib.error.HTTPError("u", code, "m", {}, io.BytesIO(b""))


def replies(*steps):
    left = list(steps)

    def post(url, body, timeout):
        step = left.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    return post


def said(text):
    return {"choices": [{"message": {"content": text}}]}


def client(*steps):
    return HttpModel("http://c", "http://e", wait_seconds=0.0, post=replies(*steps))


def test_chat_retries_and_strips_thinking():
    assert client(fail(503), said("<think>x</think> yes <think>open")).chat("q") == "yes"
    assert client(said("<think>DIRECT</think>")).route("q", "") == "<think>DIRECT</think>"
    with pytest.raises(ContextOverflow):
        client(fail(400)).chat("q")
    with pytest.raises(urllib.error.HTTPError):
        client(fail(500), fail(500), fail(500)).chat("q")


def test_embedding_reply_shapes():
    assert client({"data": [{"embedding": [1.0]}]}).embed("x") == [1.0]
    assert client({"embedding": [2.0]}).embed("x") == [2.0]
    with pytest.raises(EmbeddingUnavailable):
        client({}).embed("x")


def test_client_is_picklable():
    model = HttpModel("http://c")
    assert pickle.loads(pickle.dumps(model)) == model


def test_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("Note on Meridian networks in 2017.")
    store = str(tmp_path / "wiki")
    for command in (["ingest", str(raw)], ["ingest", str(raw), "--list"], ["search", "meridian"], ["stats"], ["dedup"]):
        run(spark, parser().parse_args([store, *command]))
    out = capsys.readouterr().out
    assert "ingested" in out and "Meridian" in out
    with pytest.raises(SystemExit):
        run(spark, parser().parse_args([store, "reset"]))
