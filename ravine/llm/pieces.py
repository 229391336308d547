"""The public piece vocabulary: read once on the driver, shipped to tasks as a bounded list."""

from __future__ import annotations

from dataclasses import dataclass

#: The vocabularies' sign for a space.
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with their scores, in the vocabulary's order, and the 256 byte pieces' presence."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_pieces: bool


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a sentencepiece model file; control, unknown and byte pieces are no text pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in plain),
        tuple(float(model.get_score(i)) for i in plain),
        sum(model.is_byte(i) for i in ids) == 256,
    )
