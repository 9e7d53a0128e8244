"""The HTTP face over a real socket."""

import base64
import json
import threading
import urllib.error
import urllib.request

import pytest

from spanloom import server


@pytest.fixture(scope="module")
def call(spark):
    running = server.serve(spark, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def ask(path, body=None):
        raw = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{running.server_address[1]}{path}", raw), timeout=120) as reply:
                return reply.status, json.load(reply)
        except urllib.error.HTTPError as wrong:
            return wrong.code, json.load(wrong)

    yield ask
    running.shutdown()


def test_round_trip(call):
    assert call("/health") == (200, {"ok": True}) and "maximum" in call("/policies")[1]["policies"]
    code, made = call("/sanitize", {"text": "mail a@x.org"})
    assert code == 200 and made["text"] == "mail [[EMAIL_001]]" and made["clean"]
    assert call("/restore", {"text": "to [[EMAIL_001]]", "vault": made["vault"]})[1]["text"] == "to a@x.org"
    assert call("/inspect", {"text": "mail a@x.org"})[1]["preview"] == "mail " + "█" * 7
    assert "<mark" in call("/review", {"text": "mail a@x.org"})[1]["html"]
    assert call("/extract", {"data": base64.b64encode(b"hi").decode(), "ext": "txt"})[1]["text"] == "hi"


@pytest.mark.parametrize(("path", "body"), [("/sanitize", {}), ("/sanitize", {"text": 1}), ("/sanitize", {"text": "a", "policy": "no"}), ("/extract", {"data": "!", "ext": "txt"}), ("/restore", []), ("/restore", b"{")])
def test_wrong_requests(call, path, body):
    assert call(path, body)[0] == 400


def test_unknown_path(call):
    assert call("/nope")[0] == 404
