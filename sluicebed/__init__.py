"""Pull-request review analytics as DataFrame-in / DataFrame-out operators."""
