"""Regular expressions that mean the same in every engine."""

#: A word edge that only ASCII letters, digits and ``_`` make.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with edges of ASCII words, as Java's own ``\b`` also counts other letters.

    ``\<`` and ``\>`` are the cheaper half of an edge, for where a word character is known to follow or to come before.
    """
    return pattern.replace(r"\b", EDGE).replace(r"\<", r"(?<!\w)").replace(r"\>", r"(?!\w)")
