"""Column-level work: tokens, string folding, brackets, captures."""
