"""Word lists and parameters that the DataFrame code and the SQL generator share."""

QUERY_STOP = tuple(
    sorted(
        """a about add all also an and any are as at be both by can could did do does each for from get had has have he in
        into is it just may might more most must new no not now of on only or other over own run same see set shall should
        so some such than that the their them then there these they this to up use used using was we were what when where
        which who will with would you your""".split()
    )
)
VOCABULARY_STOP = tuple(
    sorted(
        {
            *QUERY_STOP,
            *"""apply build change changes command commands core docs document documents examples file files format help
            index indexer indexes indexing json keep output pattern prompting reporting validation workflow""".split(),
        }
    )
)
#: Longest first; of equal length at most one can match.
SUFFIXES = tuple(
    sorted(
        "able ation ational ed ement er es ful fulness ible ical ies ing ings ity ive iveness ization ly ment ness ous ousness s".split(),
        key=lambda s: (-len(s), s),
    )
)
DOMAIN = tuple(
    sorted(
        """architecture auth authentication config configuration consequence container context decision deploy deployment
        design error failure invariant kubernetes must permission pod policy rationale rbac requires restart retry security
        service session should state test testing timeout""".split()
    )
)
CODE_CUES = ("```", "    ", "kubectl", "docker", "make", "cargo", "python", "bash")
CROSS_CUES = ("adr", "see ", "refer", "described in")

WORD = "[a-zA-Z][a-zA-Z0-9_-]*"
K1, B = 1.5, 0.75
PRIME = (1 << 31) - 1
SLOTS, BANDS = 128, 16


def minhash_coefficients() -> list[tuple[int, int]]:
    """Fixed (a, b) of the universal hashes (a * x + b) mod PRIME, from a plain linear generator so that SQL can hold them as literals."""
    x, out = 20240229, []
    for _ in range(SLOTS):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            pair.append(x % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out
