import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from poolweave.llm import pieces

from .helpers import CLASHES, DOCS, FOLDER, documents
from .test_tokens import ODD


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.default_path())


def test_best_score_equals_dynamic_programming_over_all_substrings(model):
    values = {model.names[v[2]]: v[1] for v in model.automaton.values()}
    for text in ("▁hello▁world", "▁the▁therein", "▁日本語のテキスト", "▁a☃b", "▁▁▁x", "x", "▁ééüß", "▁thththth"):
        best = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                v = values.get(text[s:e], model.unknown if e - s == 1 else float("-inf"))
                best[e] = max(best[e], best[s] + v)
        ids = model.segment(text)
        got, unknown = 0.0, 0
        for i in ids:
            if i in model.values:
                unknown += (model.values[i] & 0xC0) != 0x80
            else:
                got += values[model.names[i]]
        assert got + unknown * model.unknown == best[-1]


def test_words_apart_equal_the_whole_text(model):
    for text in ODD:
        if text:
            marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
            assert model.encode(text).tolist() == model.segment(marked)


def test_equals_the_library_with_the_same_scores(model):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for p in proto.pieces:  # the library adds in single precision: keep the sums exact
        p.score = max(p.score, -40_000.0)
    own = pieces.PieceModel.__new__(pieces.PieceModel)
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(proto.SerializeToString())
        f.flush()
        own.__init__(f.name)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    values = {v[2]: v[1] for v in own.automaton.values()}
    for text in ("hello world", "the thing and the other one", "nation of stations", "über die Straße", "a b c"):
        mine, theirs = own.encode(text).tolist(), library.encode(text)
        assert sum(values[i] for i in mine) == sum(values[i] for i in theirs)


def test_decoding_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for text in ODD:
        ids = model.encode(text)
        assert model.decode(ids) == (text or "")
        if text and "\x1c" not in text:
            assert library.decode(ids.tolist()) == text


def test_query_over_documents(spark):
    rows = list(enumerate(ODD)) + [(3, "again"), (None, "no id")]
    got = pieces.encoded(documents(spark, rows, CLASHES)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_ids for r in got}[0] == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert pieces.encoded(docs).filter("not round_trip").count() == 0
    assert pieces.encoded(spark.createDataFrame([], DOCS)).count() == 0
