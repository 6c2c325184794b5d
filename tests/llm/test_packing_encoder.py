from dendrospark.llm import packing


def test_tasks_of_a_worker_share_the_encoder_and_encode_a_run_once():
    coder = packing.encoder(packing.tokenizer_path())
    assert packing.encoder(packing.tokenizer_path()) is coder
    first = coder.encode(["one two two", "two three"])
    met, coder.known._ids = coder.known._ids, None  # a run met before needs no model
    try:
        assert packing.encoder(packing.tokenizer_path()).encode(["one two two", "two three"]) == first
    finally:
        coder.known._ids = met
