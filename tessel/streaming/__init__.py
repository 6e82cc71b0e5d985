"""Structured Streaming entry points. The reference has no stream; the text
preparation is offered on a file stream because every step is per row or uses
a static side (the language profile), and each micro-batch runs the batch plan."""
