"""Column functions without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.functions.nested import canonical_json

#: Letters of a position's pieces, in the order of their feature planes (fixed values).
PIECES = "PNBRQKpnbrqk"
#: Promotion letters in the order of their codes (fixed values).
PROMOTIONS = "nbrq"


def probability(log_weight: Column, eliminated: Column) -> Column:
    """exp of a log weight; 0 where eliminated or unknown."""
    return F.coalesce(F.when(~eliminated, F.exp(log_weight)), F.lit(0.0))


def move_log_likelihood(allowed: Column, forced: Column, triggered: Column, signals: dict[str, Column], weights: dict[str, float], breadth: float = 1.0, forced_weight: float = 0.0, quiet: float = 0.05) -> Column:
    """-ln(allowed) breadth + forced weight + s sum(weight signal), s being 1 if triggered and `quiet` if not."""
    total = F.lit(0.0)
    for name, value in signals.items():
        total = total + F.lit(float(weights.get(name, 0.0))) * value
    return -F.log(allowed.cast("double")) * breadth + F.when(forced, forced_weight).otherwise(0.0) + F.when(triggered, 1.0).otherwise(quiet) * total


def expanded_prior(prior: str, weight: str, by: list[str]) -> Column:
    """A class prior split over its variants in proportion to their weights."""
    from pyspark.sql import window as W

    return F.col(prior) * F.col(weight) / F.sum(weight).over(W.Window.partitionBy(*by))


def canonical_parameters(parameters: Column) -> Column:
    """A map or struct of parameters, nested at will, as canonical JSON (nested.canonical_json)."""
    return canonical_json(F.to_json(parameters))


def hypothesis_id(class_id: Column, parameters: Column) -> Column:
    """class::parameters, from the parameters' JSON text; null if that is refused."""
    return F.concat(class_id, F.lit("::"), canonical_json(parameters))


def supervised_parameters(parameters: Column, dropped: str = "seed") -> Column:
    """Parameters without the seed; null if nothing is left."""
    kept = F.map_filter(parameters, lambda k, v: k != dropped)
    return F.when(F.size(kept) > 0, kept)


def unit_hash(salt: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a salted SHA-256."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit(":"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def hash_split(salt: str, key: Column, parts: list[tuple[str, float]]) -> Column:
    """The name of the part of [0, 1) that the key hashes to; shares add up to 1."""
    u, found, edge = unit_hash(salt, key), F.lit(parts[-1][0]), 1.0
    for (name, _), (_, after) in zip(reversed(parts[:-1]), reversed(parts[1:]), strict=True):
        edge -= after
        found = F.when(u < round(edge, 12), name).otherwise(found)
    return found


def horizon_band(step: Column) -> Column:
    return F.when(step < 5, "0-4").when(step < 10, "5-9").when(step < 20, "10-19").when(step < 40, "20-39").otherwise("40+")


def square(file_and_rank: Column) -> Column:
    """Index of a square such as e4: file + 8 (rank - 1)."""
    return (F.ascii(F.substring(file_and_rank, 1, 1)) - 97) + 8 * (F.ascii(F.substring(file_and_rank, 2, 1)) - 49)


def move_index(uci: Column) -> Column:
    """(from 64 + to) 5 + promotion, for a move such as e7e8q; null if it is none."""
    promotion = F.coalesce(F.nullif(F.instr(F.lit(PROMOTIONS), F.substring(uci, 5, 1)), F.lit(0)), F.lit(0))
    promotion = F.when(F.length(uci) == 5, promotion).otherwise(0)
    return F.when(uci.rlike("^[a-h][1-8][a-h][1-8][nbrq]?$"), (square(F.substring(uci, 1, 2)) * 64 + square(F.substring(uci, 3, 2))) * 5 + promotion)


def board_letters(fen: Column) -> Column:
    """64 letters of a position's first field, empty squares as dots, eighth rank first."""
    board = F.regexp_replace(F.element_at(F.split(fen, " "), 1), "/", "")
    for n in range(1, 9):
        board = F.regexp_replace(board, str(n), "." * n)
    return board


#: Where a position's scalars start, and greatest values of counters (fixed values).
SCALARS, HALF_MOVES, FULL_MOVES, PLIES, LEGAL = 768, 100, 300, 600, 218


def board_features(positions: DataFrame, key: list[str], fen: str) -> DataFrame:
    """Sparse (key, index, value) features of a position of six fields.

    12 piece planes of 64 squares (a1 is 0, h8 is 63), then white or black to move, four castling rights, the
    en-passant file (a to h, or none), and the two counters as shares of their greatest values.
    """
    parts = F.split(fen, r"\s+")
    field = lambda n: F.element_at(parts, n)
    letters = positions.select(*key, F.posexplode(F.split(board_letters(F.col(fen)), "")).alias("place", "letter"))
    place = F.col("place")  # eighth rank first
    pieces = letters.where("letter <> '.' and letter <> ''").select(*key, ((F.instr(F.lit(PIECES), F.col("letter")) - 1) * 64 + (7 - F.floor(place / 8)) * 8 + place % 8).cast("int").alias("index"), F.lit(1.0).alias("value"))
    on = lambda n, flag: F.struct(F.lit(SCALARS + n).alias("index"), F.when(flag, 1.0).otherwise(0.0).alias("value"))
    share = lambda n, x, most: F.struct(F.lit(SCALARS + n).alias("index"), (F.least(x.cast("double"), F.lit(float(most))) / most).alias("value"))
    flags = [on(0, field(2) == "w"), on(1, field(2) == "b"), *(on(2 + k, F.contains(field(3), F.lit(c))) for k, c in enumerate("KQkq"))]
    flags += [*(on(6 + k, field(4).startswith(c)) for k, c in enumerate("abcdefgh")), on(14, field(4) == "-")]
    flags += [share(15, field(5), HALF_MOVES), share(16, field(6), FULL_MOVES)]
    scalars = positions.select(*key, F.explode(F.array(*flags)).alias("s")).select(*key, "s.index", "s.value").where("value <> 0")
    return pieces.unionByName(scalars)


def position_features(rows: DataFrame, key: list[str], fen: str, uci: str, white: Column, ply: Column, move_number: Column, history: Column, legal: Column) -> DataFrame:
    """board_features and, after its scalars: the player's colour, ply, move number, length of the history, legal moves, and the move's two squares as shares."""
    share = lambda n, x, most: F.struct(F.lit(SCALARS + n).alias("index"), (F.least(x.cast("double"), F.lit(float(most))) / most).alias("value"))
    move = move_index(F.col(uci))
    own = [share(17, white.cast("int"), 1), share(18, ply, PLIES), share(19, move_number, FULL_MOVES), share(20, history, PLIES), share(21, legal, LEGAL), share(22, F.floor(move / (64 * 5)), 63), share(23, F.floor(move / 5) % 64, 63)]
    scalars = rows.select(*key, F.explode(F.array(*own)).alias("s")).select(*key, "s.index", "s.value").where("value <> 0")
    return board_features(rows, key, fen).unionByName(scalars)


def san_facts(san: Column) -> dict[str, Column]:
    """Piece letter and flags of a move in short notation."""
    first = F.substring(san, 1, 1)
    return {"piece": F.when(san.startswith("O-O"), "K").when(first.isin(*"NBRQK"), first).otherwise("P"), "capture": F.contains(san, F.lit("x")), "promotion": F.contains(san, F.lit("=")), "castle": san.startswith("O-O"), "check": san.rlike("[+#]$")}


def normalized_fen(fen: Column) -> Column:
    """Six fields, castling letters in order, counters without leading zeros; null if ranks or kings are wrong."""
    parts = F.split(F.trim(fen), r"\s+")
    field = lambda n: F.element_at(parts, n)
    castling = F.concat(*(F.when(F.contains(field(3), F.lit(c)), c).otherwise("") for c in "KQkq"))
    letters = board_letters(fen)
    good = (F.size(parts) == 6) & (F.size(F.split(field(1), "/")) == 8) & (F.length(letters) == 64) & (F.length(F.regexp_replace(letters, "[^K]", "")) == 1) & (F.length(F.regexp_replace(letters, "[^k]", "")) == 1) & field(2).isin("w", "b") & field(5).rlike("^[0-9]+$") & field(6).rlike("^[0-9]+$")
    return F.when(good, F.concat_ws(" ", field(1), field(2), F.when(castling == "", "-").otherwise(castling), field(4), F.try_to_number(field(5), F.lit("999999")).cast("int").cast("string"), F.try_to_number(field(6), F.lit("999999")).cast("int").cast("string")))


def headers(text: Column) -> Column:
    """Header lines [Name "value"] as a sorted map; backslash escapes undone; the last of equal names counts."""
    line = r'(?m)^\[([A-Za-z0-9_]+) "((?:[^"\\]|\\.)*)"\]'
    names, values = F.regexp_extract_all(text, F.lit(line), F.lit(1)), F.regexp_extract_all(text, F.lit(line), F.lit(2))
    clean = F.transform(values, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
    return F.map_from_entries(F.array_sort(F.arrays_zip(names.alias("k"), clean.alias("v"))))


def semantic_hash(**parts: Column) -> Column:
    """SHA-256 of the parts as compact JSON, names sorted."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


def encoded_sequence(tokens: Column, ids: Column, length: int, unknown: int = 1) -> Column:
    """Ids of the last `length` tokens, unknown ones reserved, padded with 0 on the right."""
    last = F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - length + 1), F.lit(length))
    found = F.transform(last, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(unknown)))
    return F.concat(found, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(found))))


def symbolic_vector(p: Column, eliminated: Column) -> Column:
    """Probabilities, then the mask as numbers."""
    return F.concat(p, F.transform(eliminated, lambda e: e.cast("double")))


def piece_at(letters: Column, where: Column) -> Column:
    """The letter on a square such as e4, of 64 board letters."""
    place = (F.ascii(F.substring(where, 1, 1)) - 97) + 8 * (8 - (F.ascii(F.substring(where, 2, 1)) - 48)) + 1
    return F.substring(letters, place, F.lit(1))


def behavior_features(rows: DataFrame, key: list[str], fen: str, uci: str, legal: str) -> DataFrame:
    """Sparse (key, index, value): moved piece (0-11), captured piece (12-23), capture, promotion, and the legal moves' shares by piece (26-37)."""
    boards = rows.select(*key, board_letters(F.col(fen)).alias("letters"), F.col(uci).alias("m"), F.col(legal).alias("legal"))
    code = lambda letter: F.instr(F.lit(PIECES), letter) - 1
    moved, captured = piece_at(F.col("letters"), F.substring("m", 1, 2)), piece_at(F.col("letters"), F.substring("m", 3, 2))
    taken = captured != "."
    own = F.array(F.when(moved != ".", code(moved)), F.when(taken, 12 + code(captured)), F.when(taken, F.lit(24)), F.when(F.length("m") == 5, F.lit(25)))
    flags = boards.select(*key, F.explode(F.array_compact(own)).alias("index"), F.lit(1.0).alias("value"))
    pieces = boards.select(*key, F.size("legal").alias("n"), F.explode("legal").alias("l"), "letters")
    shares = pieces.groupBy(*key, "n", (26 + code(piece_at(F.col("letters"), F.substring("l", 1, 2)))).alias("index")).agg(F.count("*").alias("k"))
    return flags.unionByName(shares.select(*key, "index", (F.col("k") / F.col("n")).alias("value")))
