"""Sources: raw items of a board, a feed or a replay, and their normal form."""
