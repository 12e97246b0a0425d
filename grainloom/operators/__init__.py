"""DataFrame operators: windows, alignment, profiles, reshaping."""
