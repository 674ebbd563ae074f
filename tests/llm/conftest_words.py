_LETTERS = str.maketrans("0123456789", "ghijklmnop")


def words(start, n, step=7):
    """Made-up words of letters, no two of them alike within a call and few between calls."""
    return [f"w{(start * 100_003 + i * step) % 9_999_991:x}".translate(_LETTERS) for i in range(n)]
