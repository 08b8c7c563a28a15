"""Relational operators over cells, truth, symbols, clues and positions."""
