"""Public tokenizers by file: encoders for executors, and a digest of what decides the ids."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Callable
from pathlib import Path


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """sha256 over the library, its version and the vocabulary file: other ids, another digest."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    found = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    found.update(Path(path).read_bytes())
    return found.hexdigest()


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}


def _same_ranks(path: str):
    """A tiktoken encoding with the very ids of a byte-level .json vocabulary, or None.

    It gives the same ids several times faster, and is used only if all that decides them is equal: every token and id
    of the rank file beside it, the .json's own merges, which must join tokens in the order of their ids, the pattern
    that splits texts (that of byte-level vocabularies, tested on PROBE), and plain added tokens.
    """
    import public_tokenizers
    import tiktoken

    twin = Path(path).with_suffix(".tiktoken")
    whole = json.loads(Path(path).read_text())
    added = whole.get("added_tokens", [])
    step = whole.get("pre_tokenizer") or {}
    if not twin.exists() or whole.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
        return None
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, twin.read_bytes().splitlines())}
    letters, extra = _byte_letters(), {x["content"]: x["id"] for x in added}
    vocabulary = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in extra}
    if vocabulary != ranks or whole["model"].get("dropout") or whole["model"].get("ignore_merges") or not _merges_by_rank(whole["model"]) or not _same_pattern(path, public_tokenizers.PATTERN):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=extra)


#: A text with every kind of place where byte-level vocabularies split or don't.
PROBE = "I'm we'll THEY'RE 'd ' s  two   spaces\n\n new\tline end \r\n 12ab34 ²Ⅷ½ é漢字 \U0001f642\u200d’s a.b,c!? (x) _y_ \x00\x1c\x85\u00a0\u3000z\ufeff  "


def _merges_by_rank(model: dict) -> bool:
    """Whether merges make tokens in the order of their ids, and every token but the single bytes has just one merge."""
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in pairs]
    return None not in made and all(x < y for x, y in zip(made, made[1:]))


def _same_pattern(path: str, pattern: str) -> bool:
    import regex
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(PROBE)
    return [PROBE[a:b] for _, (a, b) in found] == regex.findall(pattern, PROBE)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids, without begin, end or other added tokens; special strings as the library does by default."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text, num_threads=1)
    if fast := _same_ranks(path):
        return lambda text: fast.encode(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: slow.encode(text, add_special_tokens=False).ids
