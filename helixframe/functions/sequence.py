"""Column expressions over nucleotide sequences (F1-F8).

Sequences stay STRING for as long as possible: ``translate``, ``reverse``,
``substr`` and ``concat`` run inside whole-stage codegen, while array
higher-order functions are interpreted.  An encoded sequence is therefore a
*digit string* (one character per base, the character is the code); arrays
are only built at a sink with :func:`digits_to_array`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's codebooks and vocabulary.
#
# N-first codebook, both cases:  N=0 A=1 C=2 G=3 T=4 U=4
# A-first codebook, both cases:  A=0 C=1 G=2 T=3 N=4   (no U)
# Token vocabulary (ids 0..9):   [PAD] [UNK] [CLS] [SEP] [MASK] N A C G T
# Tokens = [CLS=2] + (code + 5) + [SEP=3]
# ---------------------------------------------------------------------------
NFIRST = {"N": 0, "A": 1, "C": 2, "G": 3, "T": 4, "U": 4}
AFIRST = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
CODEBOOKS = {"nfirst": NFIRST, "afirst": AFIRST}
VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "N", "A", "C", "G", "T"]
CLS_ID, SEP_ID, CODE_OFFSET = 2, 3, 5

# Complement pairs used for the reverse strand (case is kept).
COMPLEMENT_FROM = "ACGTUNacgtun"
COMPLEMENT_TO = "TGCAANtgcaan"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _codebook_maps(codebook: str | dict):
    book = CODEBOOKS[codebook] if isinstance(codebook, str) else codebook
    letters, digits = [], []
    for base, code in book.items():
        if not 0 <= int(code) <= 9:
            raise ValueError("codes must be single digits")
        for ch in (base.upper(), base.lower()):
            letters.append(ch)
            digits.append(str(code))
    return "".join(letters), "".join(digits), book


def encode(col, codebook: str | dict = "nfirst", mode: str = "strict") -> Column:
    """encode a base string as a digit string under ``codebook``.

    ``mode="strict"`` raises on a letter outside the codebook (the reference
    fails with a KeyError); ``mode="to_n"`` maps such letters to N;
    ``mode="trusted"`` skips the check (sequences from a validated store).
    """
    letters, digits, book = _codebook_maps(codebook)
    s = _col(col)
    bad = f"[^{letters}]"
    if mode == "to_n":
        if "N" not in book:
            raise ValueError("codebook has no N")
        s = F.regexp_replace(s, bad, "N")
    elif mode == "trusted":
        pass  # input known to hold only codebook letters (a validated store)
    elif mode == "strict":
        s = F.when(~s.rlike(bad), s).otherwise(
            F.raise_error(F.concat(F.lit("unknown base in sequence: "), F.substring(s, 1, 60))))
    else:
        raise ValueError(f"mode must be 'strict', 'to_n' or 'trusted', got {mode!r}")
    return F.translate(s, letters, digits)


def shift_codes(codes, offset: int) -> Column:
    """``codes + offset`` on a digit string, for codes below ``10 - offset``."""
    if offset < 0 or offset > 9:
        raise ValueError("offset must keep codes single digits")
    src = "0123456789"
    return F.translate(_col(codes), src[: 10 - offset], src[offset:]) if offset else _col(codes)


def code_alphabet(codebook: str | dict = "nfirst", offset: int = 0) -> tuple[str, tuple[str, str]]:
    """The digit of N, and the digits of a codebook with those of their complements."""
    book = _codebook_maps(codebook)[2]
    pairs: dict[str, str] = {}
    for a, b in zip(COMPLEMENT_FROM, COMPLEMENT_TO, strict=True):
        if a in book:
            digit, other = str(book[a] + offset), str(book.get(b, book["N"]) + offset)
            if max(len(digit), len(other)) > 1 or pairs.setdefault(digit, other) != other:
                raise ValueError("the codebook's digits have no complement")
    return str(book["N"] + offset), ("".join(pairs), "".join(pairs.values()))


def encode_nfirst(col, mode: str = "strict") -> Column:
    return encode(col, "nfirst", mode)


def encode_afirst(col, mode: str = "strict") -> Column:
    return encode(col, "afirst", mode)


def to_tokens(codes, cls: int | None = CLS_ID, sep: int | None = SEP_ID,
              offset: int = CODE_OFFSET) -> Column:
    """``[cls] ++ (codes + offset) ++ [sep]`` on a digit string.

    Codes 0-4 plus 5 stay single digits, so the result is again a digit
    string (codegen-friendly).  ``cls``/``sep`` may be None to leave them out.
    """
    shifted = shift_codes(codes, offset)
    parts = []
    if cls is not None:
        parts.append(F.lit(str(cls)))
    parts.append(shifted)
    if sep is not None:
        parts.append(F.lit(str(sep)))
    return F.concat(*parts)


def digits_to_array(digits, dtype: str = "tinyint") -> Column:
    """Sink form: digit string -> ARRAY<dtype>; the empty string gives []."""
    d = _col(digits)
    return F.when(F.length(d) == 0, F.array().cast(f"array<{dtype}>")).otherwise(
        F.transform(F.split(d, ""), lambda c: c.cast(dtype)))


def reverse_complement(col, complement: tuple[str, str] = (COMPLEMENT_FROM, COMPLEMENT_TO)) -> Column:
    """F4 on text: reverse and complement (A<->T, C<->G, U->A, N fixed, case kept)."""
    return F.reverse(F.translate(_col(col), *complement))


def reverse_complement_codes(digits) -> Column:
    """F4 on N-first codes: reverse and map 1<->4, 2<->3, 0 fixed."""
    return F.reverse(F.translate(_col(digits), "01234", "04321"))


def reverse_complement_array(arr) -> Column:
    """F4 on an N-first code array."""
    return F.transform(F.reverse(_col(arr)),
                       lambda x: F.when(x == 0, x).otherwise(5 - x).cast("tinyint"))


def pad_sequence(col, left, right, fill: str = "N") -> Column:
    """``fill * left + s + fill * right``; negative counts pad nothing."""
    left = F.greatest(F.lit(0), _col(left) if not isinstance(left, int) else F.lit(left))
    right = F.greatest(F.lit(0), _col(right) if not isinstance(right, int) else F.lit(right))
    return F.concat(F.repeat(F.lit(fill), left), _col(col), F.repeat(F.lit(fill), right))


def kmer_items(text, k: int, n_starts, step: int = 1, phase=0) -> Column:
    """Items ``text[j:j+k]`` for j in [0, n_starts) with (j + phase) % step == 0;
    items near the end of ``text`` are shorter.

    Linear in the text: the character array is zipped with k-1 shifted
    slices of itself (array access is O(1); ``substr`` on a string walks
    from the start, which would make per-item substrings quadratic).
    """
    chars = F.split(_col(text), "")
    acc = chars
    for j in range(1, k):
        shifted = F.slice(chars, j + 1, F.greatest(F.size(chars), F.lit(1)))
        acc = F.zip_with(acc, shifted, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    n = n_starts if isinstance(n_starts, Column) else F.lit(n_starts)
    acc = F.slice(acc, 1, n.cast("int"))
    if step > 1:
        ph = phase if isinstance(phase, Column) else F.lit(phase)
        acc = F.filter(acc, lambda x, i: F.pmod(i + ph, F.lit(step)) == 0)
    return acc


def kmers(col, k: int, left_pad: int = 0, right_pad: int = 0, step: int = 1) -> Column:
    """k-mers of ``N*left_pad + s + N*right_pad`` starting at 0, step, ...
    while the start is below ``len(s)``.  Tail items are shorter than k when
    the right padding runs out.  The empty sequence gives []."""
    if k <= 0 or step <= 0:
        raise ValueError("k and step must be positive")
    s = _col(col)
    n = F.length(s)
    items = kmer_items(pad_sequence(s, left_pad, right_pad), k, n, step)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(items)


def parse_positions(col, compat: bool = False) -> Column:
    """comma list of 1-based positions -> 0-based ARRAY<BIGINT>.

    Lists carry a trailing comma.  ``compat=True`` drops the last item
    always (the reference's behaviour); otherwise only an empty last item is
    dropped, so a list without the final comma keeps its last position.
    """
    parts = F.split(F.coalesce(_col(col), F.lit("")), ",")
    n = F.size(parts)
    if compat:
        kept = F.slice(parts, 1, n - 1)
    else:
        kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.trim(x).cast("bigint") - 1)


def to_half_open(tx_start, tx_end) -> tuple[Column, Column]:
    """F8: 1-based closed -> 0-based half-open."""
    return _col(tx_start) - 1, _col(tx_end)
