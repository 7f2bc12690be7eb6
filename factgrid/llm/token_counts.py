"""Token counts of texts under a unigram model, by dynamic programming over a trie."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .common import map_rows

#: A vocabulary is sent to every executor; larger ones are refused.
MAX_PIECES = 1_000_000
#: Fixed value: what the unknown piece scores below the worst piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Prefixes of so many characters are shared in the trie; what a pre-token has beyond is worked out in a window of its own.
DEPTH = 64
#: Forward scores of a long pre-token that are held at once.
HELD = 65_536


class Pieces:
    """Pieces and their log-probabilities from a sentencepiece file.

    A unigram file has them as scores. A BPE file only ranks its pieces; by Zipf's law, the
    piece of rank r has a share in proportion to 1 / r.
    """

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as f:
            model = ModelProto.FromString(f.read())
        sp = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        if sp.get_piece_size() > MAX_PIECES:
            raise ValueError(f"{sp.get_piece_size()} pieces; at most {MAX_PIECES} are sent to executors")
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if model.trainer_spec.model_type == model.trainer_spec.BPE:
            total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
            scores = [-math.log(r) - total for r in range(1, len(plain) + 1)]
        else:
            scores = [float(sp.get_score(i)) for i in plain]
        self.score = {sp.id_to_piece(i).replace(SPACE, " "): s for i, s in zip(plain, scores, strict=True)}
        self.key = hashlib.sha256(repr(sorted(self.score.items())).encode()).hexdigest()
        self.byte_fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            ends.setdefault(piece[-1], set()).add(len(piece))
        #: Lengths of the pieces that end in a character.
        self.lengths = {c: sorted(n) for c, n in ends.items()}
        # A space never stands behind another character inside a piece, so a pre-token starts at
        # each run of spaces; a line feed that no longer piece holds is a pre-token of its own.
        if any(re.search("[^ ] ", p) for p in self.score):
            raise ValueError("pieces that go on behind a space have no pre-tokens")
        alone = not any("\n" in p and len(p) > 1 for p in self.score)
        self.longest = max(map(len, self.score), default=1)
        self.pretoken = re.compile(r" +[^ \n]*|[^ \n]+|\n" if alone else r" +[^ ]*|[^ ]+")


_LAST: dict[str, Trie] = {}


def trie_of(pieces: Pieces, max_nodes: int) -> Trie:
    """The worker process's trie: the next task of the same model goes on with it."""
    key = f"{pieces.key} {max_nodes}"
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Trie(pieces, max_nodes)
    return _LAST[key]


class Trie:
    """Best forward score of every prefix, and its number of tokens, worked out once per node.

    A node is a prefix of pre-tokens, of DEPTH characters at most; score[node] is the best sum of piece scores that covers it,
    tokens[node] the fewest tokens among the segmentations of that score. `terminal` holds
    the counts of whole pre-tokens. There are never more than max_nodes nodes, or those of one pre-token.
    """

    def __init__(self, pieces: Pieces, max_nodes: int):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # of a node and a character, as one number
        self.score, self.tokens = [0.0], [0]
        self.full = False

    def insert(self, words: Iterable[str]) -> None:
        """Adds words in order, so that the path of what a word shares with the one before is walked once."""
        known, lengths, unknown, longest = self.pieces.score, self.pieces.lengths, self.pieces.unknown, self.pieces.longest
        path, scores, counts, last = [0], [0.0], [0], ""  # of the prefixes of the last word: nodes, and what they hold
        for word in sorted(words):
            if len(self.score) + min(len(word), DEPTH) > self.max_nodes:
                self.clear()
                self.full, path, scores, counts, last = True, [0], [0.0], [0], ""
            child, score, tokens = self.child, self.score, self.tokens
            shared, most = 0, min(len(word), len(last), DEPTH)
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :], scores[shared + 1 :], counts[shared + 1 :]
            node, last, base = path[shared], word, 0
            for depth in range(shared + 1, len(word) + 1):
                c = word[depth - 1]
                edge = node << 21 | ord(c)
                nxt = child.get(edge) if depth <= DEPTH else None
                if nxt is None:
                    best, fewest = None, 0
                    for n in lengths.get(c, ()):
                        if n > depth:
                            break
                        s = known.get(word[depth - n : depth])
                        if s is not None:
                            s, k = s + scores[depth - n - base], counts[depth - n - base] + 1
                            if best is None or s > best or (s == best and k < fewest):
                                best, fewest = s, k
                    if c not in known:
                        s, k = scores[-1] + unknown, counts[-1] + (len(c.encode("utf-8", "surrogatepass")) if self.pieces.byte_fallback else 1)
                        if best is None or s > best or (s == best and k < fewest):
                            best, fewest = s, k
                    if depth <= DEPTH:
                        nxt = child[edge] = len(score)
                        score.append(best)
                        tokens.append(fewest)
                else:
                    best, fewest = score[nxt], tokens[nxt]
                scores.append(best)
                counts.append(fewest)
                if depth <= DEPTH:
                    node = nxt
                    path.append(node)
                elif len(scores) > HELD:
                    gone = len(scores) - longest
                    del scores[:gone], counts[:gone]
                    base += gone
            self.terminal[word] = counts[-1]
            if base:
                path, scores, counts, last = [0], [0.0], [0], ""

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text, with the model's space in front unless it is empty."""
        if self.full:
            self.terminal.clear()
            self.full = False
        split = [self.pieces.pretoken.findall(" " + t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.terminal)
        self.insert(fresh)
        get = self.terminal.__getitem__
        found = [(sum(map(get, words)), len(words)) for words in split]
        for word in fresh:
            if len(word) > DEPTH:
                del self.terminal[word]
        return found


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 1_200_000) -> DataFrame:
    """Counts the tokens of every text: columns id_col, n_tokens, n_pretokens (long).

    The model is the unigram one over the pieces of a sentencepiece file: a text's segmentation
    has the greatest sum of log-probabilities, and among equal sums the fewest tokens.
    Characters without a piece count as their UTF-8 bytes. Each worker process keeps a trie of the
    pre-tokens it has met; beyond max_nodes it starts anew, which changes no count. What a pre-token has beyond DEPTH characters is
    worked out in a window that is not stored, so memory is bounded for texts without white space, too. No shuffle.

    Null and empty texts: 0 and 0. Rows with equal or null ids are counted one by one.
    Other columns are neither read nor returned. An empty table gives an empty one.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        trie = trie_of(pieces.value, max_nodes)

        def step(rows: dict) -> dict:
            counts = trie.count(rows["t"])
            return {id_col: rows["i"], "n_tokens": [c[0] for c in counts], "n_pretokens": [c[1] for c in counts]}

        return step

    frame = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return map_rows(frame, start, f"`{id_col}` {id_type}, n_tokens long, n_pretokens long")


def brute_force_count(pieces: Pieces, text: str | None) -> int:
    """The same count by one pass over the whole text, without pre-tokens or trie. For tests."""
    if not text:
        return 0
    text = " " + text
    best: list[tuple[float, int]] = [(0.0, 0)]

    def options(end: int) -> Iterator[tuple[float, int]]:
        for start in range(max(0, end - pieces.longest), end):
            s = pieces.score.get(text[start:end])
            if s is not None:
                yield best[start][0] + s, -(best[start][1] + 1)
        if text[end - 1] not in pieces.score:
            yield best[end - 1][0] + pieces.unknown, -(best[end - 1][1] + (len(text[end - 1].encode()) if pieces.byte_fallback else 1))

    for end in range(1, len(text) + 1):
        s, k = max(options(end))
        best.append((s, -k))
    return best[-1][1]
