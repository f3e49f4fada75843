import io
import json
import threading
import urllib.request

from gleaner.api import Engine
from gleaner.service import Service, Tools, serve, serve_lines

CSV = "date,region,revenue\n" + "\n".join(f"2025-01-{d:02d},{'ab'[d % 2]},{d * 10}" for d in range(1, 11))


def test_routes(spark):
    s = Service(Engine(spark, planner=lambda ds, q: {"metrics": [{"measure": "revenue"}], "group_by": ["region"]}))
    assert s.dispatch("GET", "/api/status")[1]["planner"] and s.dispatch("POST", "/api/datasets", {"name": "x"})[0] == 400
    status, made = s.dispatch("POST", "/api/datasets", {"name": "x", "content": CSV, "format": "auto"})
    key = made["dataset"]["id"]
    top = f"/api/datasets/{key}"
    assert status == 201 and "rows" in made["dataset"] and len(s.dispatch("GET", "/api/datasets")[1]["datasets"]) == 1
    q = {"metrics": [{"measure": "revenue", "aggregation": "sum"}], "groupBy": ["region"], "filters": [{"field": "revenue", "operator": "gt", "value": 20}], "orderBy": [{"field": "region", "direction": "asc"}]}
    assert s.dispatch("POST", f"{top}/query", q)[1]["result"]["rows"] == [("a", 280.0), ("b", 240.0)]
    assert s.dispatch("POST", f"{top}/ask", {"question": "?"})[1]["result"]["columns"] == ["region", "sum(revenue)"]
    status, bad = s.dispatch("POST", f"{top}/query", {"metrics": ["revenu"]})
    assert status == 400 and "revenue" in bad["suggestions"]
    patched = s.dispatch("PATCH", f"{top}/semantic", {"reviewed": True, "measures": [{"name": "revenue", "unit": "EUR"}, {"name": "zz"}]})[1]
    assert patched["semantic"]["reviewed"] and patched["unmatched"] == ["zz"]
    assert len(s.dispatch("GET", f"{top}/profile?column=region")[1]["columns"]) == 1
    frames = list(s.dispatch("GET", f"{top}/analyze?focus=revenue")[1])
    assert json.loads(frames[-1][6:])["phase"] == "done" and all(f.startswith("data: ") and f.endswith("\n\n") for f in frames)
    assert s.dispatch("GET", f"{top}/insights")[0] == 200 and s.dispatch("GET", "/api/datasets/none")[0] == 404 and s.dispatch("GET", "/x")[0] == 404
    assert s.dispatch("POST", "/api/samples", {"id": "none"})[0] == 404
    assert s.dispatch("DELETE", top)[1] == {"deleted": True} and s.dispatch("GET", top)[0] == 404
    assert Service(Engine(spark)).dispatch("POST", "/api/datasets", {"name": "e", "content": "a,b\n"})[0] == 400


def test_server(spark):
    server = serve(Engine(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/api/status"
    assert json.load(urllib.request.urlopen(url))["ok"]
    server.shutdown()


def test_tools(spark):
    engine = Engine(spark)
    t = Tools(engine)
    call = lambda tool, /, **a: t.handle({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}})["result"]
    assert len(t.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 10
    key = json.loads(call("upload_dataset", name="x", content=CSV)["content"][0]["text"])["id"]
    assert "a" in call("query_data", dataset_id=key, metrics=[{"measure": "revenue"}], group_by=["region"])["content"][0]["text"]
    assert "MEASURES" in call("get_semantic_model", dataset_id=key)["content"][0]["text"]
    assert json.loads(call("update_semantic_model", dataset_id=key, measures=[{"name": "q"}])["content"][0]["text"]) == {"unmatched": ["q"]}
    assert call("ask", dataset_id=key, question="?")["isError"] and call("profile_dataset", dataset_id="none")["isError"]
    assert "Plan:" in call("analyze_dataset", dataset_id=key)["content"][0]["text"] and "isError" not in call("get_insights", dataset_id=key)
    out = io.StringIO()
    serve_lines(engine, io.StringIO('{"id": 1, "method": "initialize"}\n\nnonsense\n{"method": "note"}\n{"id": 2, "method": "resources/read", "params": {"uri": "gleaner://datasets"}}\n{"id": 3, "method": "x"}\n'), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a.get("id") for a in answers] == [1, None, 2, 3] and "error" in answers[3] and key in answers[2]["result"]["contents"][0]["text"]
    assert json.loads(call("delete_dataset", dataset_id=key)["content"][0]["text"])["deleted"] and call("list_datasets")["content"][0]["text"] == "[]"
