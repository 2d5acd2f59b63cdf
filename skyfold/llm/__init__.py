"""Training-data operators over document tables; nothing else in the library imports this folder."""
