"""Row shapes of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

POSITIVE = tuple("ADVISE EFFECT INT MECHANISM".split())
NONE = "NONE"
LABELS = (NONE, *POSITIVE)
MODES = ("markers", "mask_targets", "mask_all")


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

#: One labelled pair in one sentence; pair_no orders the pairs of a sentence.
INSTANCE = _s(text=S, label=S, source=S, sent_id=S, pair_no=I)
ENTITY = _s(id=S, type=S, begin=I, end=I, text=S)
RELATION = _s(id=S, type=S, arg1=S, arg2=S)
DOCUMENT = _s(doc_id=S, register=S, text=S, entities=T.ArrayType(ENTITY), relations=T.ArrayType(RELATION))
SENTENCE = _s(sent_id=S, register=S, text=S, entities=T.ArrayType(ENTITY), relations=T.ArrayType(RELATION))
SPEC_ENTITY = _s(key=S, surface=S, type=S)
ASSERTED = _s(between=T.ArrayType(S), label=S)
#: A generation request; asserts is the older name of positives, and either may be missing.
SPEC = _s(spec_index=L, frame=S, kind=S, register=S, register_line=S, entities=T.ArrayType(SPEC_ENTITY), shape=S, says=T.ArrayType(_s(k=S, v=S)), avoid=T.ArrayType(S), positives=T.ArrayType(ASSERTED), asserts=T.ArrayType(ASSERTED), roles=T.MapType(S, S), role_pos=S, scene=S, axes=T.MapType(S, S), matrix=T.MapType(S, S))
RAW = _s(spec_index=L, spec=S, sample=S, error=S)
SAMPLE_SENTENCE = _s(sentence=S)
SAMPLE_PASSAGE = _s(sentences=T.ArrayType(_s(text=S, relations=T.ArrayType(_s(arg1=S, arg2=S, label=S)))), entities=T.ArrayType(_s(text=S, type=S)))
BATCH = _s(sent_id=S, text=S, pairs=T.ArrayType(T.ArrayType(I)), names=T.ArrayType(T.ArrayType(S)), gold=T.ArrayType(S), n_mentions=I)
VERDICTS = _s(verdicts=T.ArrayType(_s(pair=I, annotated=B)))
MANIFEST = _s(dataset_id=S, created_at=S, provenance=S, generator=S, vocab_source=S, negative_strategy=S, parent_id=S, render_mode=S, seed=I, size=_s(n_instances=L, n_sentences=L), label_distribution=T.MapType(S, L), data_root=S, sha256=S, leakage_report=S, git_sha=S, git_dirty=B, notes=S)
RUN = _s(run_id=S, timestamp=S, train_id=S, eval_id=S, config=T.MapType(S, S), metrics=T.MapType(S, D), notes=S, git_sha=S, git_dirty=B)
CURVE = _s(budget=S, n_sentences=L, arm=S, seed=L, n_instances=L, pos_rate=D, f1=D, p=D, r=D)
