import http.client
import json
import threading

import pytest

from khatasort.operators.learning import Store
from khatasort.serve import server

STATEMENT = "date,counterparty,type,amount\n2026-01-02,Sun Kirana,DEBIT,10\n2026-01-02,Asha Verma,DEBIT,10\nsoon,KFC,DEBIT,10\n"


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    http_server = server(Store(spark, str(tmp_path_factory.mktemp("store"))), fuzzy=False)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()

    def request(method, path, body=b"", kind="application/json", **headers):
        c = http.client.HTTPConnection("127.0.0.1", http_server.server_address[1], timeout=120)
        c.request(method, path, body, {"Content-Type": kind} | headers)
        r = c.getresponse()
        data = r.read().decode()
        return r.status, json.loads(data) if r.getheader("Content-Type") == "application/json" else data

    yield request
    http_server.shutdown()


def test_answers(ask):
    assert ask("GET", "/api/categories")[1][0] == "GROCERIES"
    assert ask("POST", "/api/classify", json.dumps({"text": "Sun Kirana"}))[1]["category"] == "GROCERIES"
    status, found = ask("POST", "/api/categorize", STATEMENT, "text/csv")
    assert status == 200 and found["summary"]["classified"] == 2 and found["csv"].count("\n") == 4
    assert found["summary"] == {"inputRows": 3, "classified": 2, "needsReview": 0, "other": 0, "skipped": 1, "problems": {"unparseable date": 1}, "uniqueMerchants": 2}
    assert found["byCategory"] == {"GROCERIES": 1, "PERSONAL_TRANSFER": 1} and found["rows"][0]["date"] == "2026-01-02" and found["rows"][0]["needsReview"] is False
    assert ask("GET", "/")[1]["service"] == "khatasort" and ask("GET", "/favicon.ico")[0] == 204
    assert ask("POST", "/api/correct", json.dumps({"counterparty": "Asha Verma", "category": "HEALTH"})) == (200, {"updated": 0})
    assert "Asha Verma,HEALTH" in ask("POST", "/api/merchants", STATEMENT, "text/csv")[1]
    assert ask("GET", "/api/state")[1] == {"overrides": 1, "learned": 1}


@pytest.mark.parametrize(
    ("call", "status"),
    [
        (("GET", "/nowhere"), 404),
        (("POST", "/api/classify", "{"), 400),
        (("POST", "/api/classify", "[]"), 400),
        (("POST", "/api/classify", '{"text": " "}'), 400),
        (("POST", "/api/categorize", "", "text/csv"), 400),
        (("POST", "/api/classify", "{}", "text/plain"), 415),
        (("POST", "/api/correct", "{}"), 422),
        (("POST", "/api/categorize", "a,b\n1,2\n", "text/csv"), 422),
    ],
)
def test_mistakes(ask, call, status):
    assert ask(*call)[0] == status


def test_other_hosts_are_refused(ask):
    assert ask("GET", "/api/state", Host="evil.example")[0] == 403
