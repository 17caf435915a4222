"""Writers of netlists, graphs and reports."""
