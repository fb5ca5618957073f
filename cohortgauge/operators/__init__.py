"""DataFrame-to-DataFrame operators. Each takes frames covering every site at once."""
