SOURCE = "struct<kind:string,url:string,ref:string,reported_by:string,published:string,fetched_at:string>"
RECORDS = f"record_id bigint, run_id string, model_id string, benchmark_id string, score double, config string, source {SOURCE}, variants array<struct<score:double,config:string,source:{SOURCE}>>, extra string, _k string, n int"
MODELS = "id string, name string, vendor string, aliases array<string>"
BENCHMARKS = "id string, name string, category string, scale string"


def record(i, score, run="r", model="m", bench="b", config=None, source=None, variants=None, extra=None):
    """A row of RECORDS, with two extra columns whose names clash with inner ones."""
    return (i, run, model, bench, score, config, source, variants, extra, "x", 7)


def source(kind=None, url=None, ref=None, by=None, published=None, fetched=None):
    return (kind, url, ref, by, published, fetched)
