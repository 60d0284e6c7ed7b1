"""Table schemas, enums and record contracts (section 1 of the survey)."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed enums of the data model.
DIFFICULTIES = ["Easy", "Medium", "Hard", "easy", "medium", "hard"]
EXECUTION_STATUSES = ["OK", "FAIL", "CRASH", "TIMEOUT", "OOM", "SKIPPED"]
METHODS = ["ruff", "pylint_ros", "pytest", "hypothesis", "z3"]
DEFAULT_ENABLED_METHODS = ["ruff", "pylint_ros", "pytest", "hypothesis"]
DEFAULT_REQUIRED_METHODS = ["ruff", "pytest"]

EXPERIMENTS = T.StructType([
    T.StructField("experiment_id", T.StringType(), False),
    T.StructField("config_hash", T.StringType(), False),
    T.StructField("config_json", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType(), True),
    T.StructField("git_sha", T.StringType(), True),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("experiment_id", T.StringType(), False),
    T.StructField("task_id", T.StringType(), False),
    T.StructField("candidate_idx", T.IntegerType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("prompt_tokens", T.IntegerType(), True),
    T.StructField("completion_tokens", T.IntegerType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
    T.StructField("seed", T.IntegerType(), True),
    T.StructField("code", T.StringType(), True),
    T.StructField("gen_error", T.StringType(), True),
    T.StructField("overall_pass", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("ingest_seq", T.LongType(), False),
])

METHOD_RESULTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("experiment_id", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("passed", T.IntegerType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("exit_code", T.IntegerType(), True),
    T.StructField("duration_ms", T.DoubleType(), True),
    T.StructField("stdout", T.StringType(), True),
    T.StructField("stderr", T.StringType(), True),
    T.StructField("findings_json", T.StringType(), True),
    T.StructField("ingest_seq", T.LongType(), False),
])

TOPIC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("qos", T.StructType([T.StructField("depth", T.IntegerType())])),
])

INTERFACE_SPEC = T.StructType([
    T.StructField("node_name", T.StringType()),
    T.StructField("topics_published", T.ArrayType(TOPIC)),
    T.StructField("topics_subscribed", T.ArrayType(TOPIC)),
    T.StructField("services_provided", T.ArrayType(T.VariantType())),
    T.StructField("services_used", T.ArrayType(T.VariantType())),
    T.StructField("actions_provided", T.ArrayType(T.VariantType())),
    T.StructField("actions_used", T.ArrayType(T.VariantType())),
    T.StructField("parameters", T.ArrayType(T.VariantType())),
])

# Closed record contracts (A4): allowed keys, required keys, enum checks, kinds of values.
# A kind says what a value may be read as (a whole number may come as "5" or 5.0); with a
# question mark null is allowed too. Nested objects and lists name their own contract;
# ``variants`` choose the keys by the value of one field.
_TIMED = {"timeout_sec": "num"}
CONTRACTS = {
    "execution_result": {
        "allowed": ["status", "stdout", "stderr", "exit_code", "duration_ms", "timed_out"],
        "required": ["status"],
        "enums": {"status": EXECUTION_STATUSES},
        "kinds": {"stdout": "str", "stderr": "str", "exit_code": "int?", "duration_ms": "num", "timed_out": "bool"},
    },
    "method_result": {
        "allowed": ["method", "passed", "score", "findings", "execution"],
        "required": ["method", "passed", "execution"],
        "enums": {"method": METHODS},
        "kinds": {"passed": "bool", "score": "num?", "findings": "objects"},
        "objects": {"execution": "execution_result"},
    },
    "verification_result": {
        "allowed": ["task_id", "candidate_idx", "methods", "overall_pass"],
        "required": ["task_id", "candidate_idx"],
        "enums": {},
        "kinds": {"task_id": "str", "candidate_idx": "int", "methods": "list", "overall_pass": "bool"},
        "lists": {"methods": "method_result"},
    },
    "generation_result": {
        "allowed": ["task_id", "candidate_idx", "text", "raw_response", "prompt_tokens", "completion_tokens",
                    "latency_ms", "model", "provider", "seed", "temperature", "error"],
        "required": ["task_id", "candidate_idx", "text", "model", "provider"],
        "enums": {},
        "kinds": {"task_id": "str", "candidate_idx": "int", "text": "str", "raw_response": "str?", "prompt_tokens": "int",
                  "completion_tokens": "int", "latency_ms": "num", "model": "str", "provider": "str", "seed": "int?",
                  "temperature": "num?", "error": "str?"},
    },
    # The strict oracle check: each kind of check has keys of its own.
    "oracle_check": {
        "required": ["check_type"],
        "variants": {"by": "check_type", "of": {
            "node_exists": {"required": ["node_name"], "kinds": {"node_name": "str", **_TIMED}},
            "topic_published": {"required": ["topic", "msg_type"],
                                "kinds": {"topic": "str", "msg_type": "str", "min_count": "int", **_TIMED}},
            "topic_subscribed": {"required": ["topic", "msg_type"], "kinds": {"topic": "str", "msg_type": "str", **_TIMED}},
            "message_content": {"required": ["topic", "field", "expected"],
                                "kinds": {"topic": "str", "field": "str", "expected": "any"}},
            "log_output_contains": {"required": ["pattern"], "kinds": {"pattern": "str", "after_publish": "bool", **_TIMED}},
            "service_called": {"required": ["service", "srv_type"], "kinds": {"service": "str", "srv_type": "str", **_TIMED}},
            "parameter_value": {"required": ["node", "parameter", "expected"],
                                "kinds": {"node": "str", "parameter": "str", "expected": "any"}},
        }},
    },
}
