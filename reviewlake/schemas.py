"""Explicit schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

STR, LONG, INT, BOOL, DBL = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.DoubleType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


DELIVERIES = _struct(
    delivery_id=LONG,
    event_type=STR,
    signature=STR,
    body=T.BinaryType(),
    received_at=T.TimestampType(),
)

_REF = _struct(ref=STR, sha=STR)

PULL_REQUEST_EVENT = _struct(
    action=STR,
    number=LONG,
    pull_request=_struct(
        number=LONG, title=STR, state=STR, head=_REF, base=_REF, diff_url=STR
    ),
    repository=_struct(full_name=STR, owner=_struct(login=STR), name=STR),
    installation=_struct(id=LONG),
)

REVIEW_JOBS = _struct(
    installation_id=LONG,
    repo_full_name=STR,
    owner=STR,
    repo_name=STR,
    pr_number=LONG,
    head_sha=STR,
    base_sha=STR,
)

PR_DIFFS = _struct(repo_full_name=STR, pr_number=LONG, head_sha=STR, raw=STR)

SOURCE_FILES = _struct(repo_full_name=STR, path=STR, ref=STR, content=STR)

#: One row per configuration file seen at a revision. ``priority`` 0 is the
#: ``.yaml`` spelling, 1 the ``.yml`` one; ``valid`` is false when the file
#: could not be decoded.
REPO_CONFIGS = _struct(
    repo_full_name=STR,
    ref=STR,
    priority=INT,
    valid=BOOL,
    version=LONG,
    rules=T.ArrayType(_struct(name=STR, enabled=BOOL)),
    exclude_paths=T.ArrayType(STR),
    provider=STR,
    model=STR,
)

FINDINGS = _struct(
    repo_full_name=STR,
    pr_number=LONG,
    file_idx=INT,
    file_path=STR,
    ord=LONG,
    rule=STR,
    severity=STR,
    message=STR,
    line=LONG,
    diff_pos=LONG,
)

MODEL_FINDINGS = T.StructType(
    FINDINGS.fields + _struct(confidence=DBL, suggested_fix=STR).fields
)

MODEL_RESPONSES = _struct(
    repo_full_name=STR,
    pr_number=LONG,
    head_sha=STR,
    path=STR,
    stage=STR,
    attempt=INT,
    content=STR,
    error=STR,
)

CANDIDATE = _struct(category=STR, line=LONG, message=STR)
ITEM = _struct(category=STR, line=LONG, message=STR, explanation=STR, suggested_fix=STR)
REVIEWED = _struct(
    category=STR,
    line=LONG,
    message=STR,
    explanation=STR,
    suggested_fix=STR,
    confidence=DBL,
    decision=STR,
)
DETECTOR_PAYLOAD = _struct(candidates=T.ArrayType(CANDIDATE))
SUGGESTER_PAYLOAD = _struct(items=T.ArrayType(ITEM))
REVIEWER_PAYLOAD = _struct(items=T.ArrayType(REVIEWED))

FINDING_HISTORY = _struct(
    id=STR,
    repo=STR,
    file_path=STR,
    rule=STR,
    message=STR,
    embedding=T.ArrayType(T.FloatType()),
    pr_number=LONG,
    created_at=T.TimestampType(),
)

REVIEW_COMMENT = _struct(path=STR, position=LONG, body=STR)
REVIEWS = _struct(
    repo_full_name=STR,
    pr_number=LONG,
    commit_id=STR,
    body=STR,
    event=STR,
    comments=T.ArrayType(REVIEW_COMMENT),
)
