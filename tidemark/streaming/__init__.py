"""No operator here needs a stream: every input is one finished set of fact tables."""
