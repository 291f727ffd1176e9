"""Programs over graphs and the loop that drives them."""
