"""Sources: the event table as order events, quotes, files and streams of them."""
