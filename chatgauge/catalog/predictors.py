"""Small deterministic predictors for the registered queries and the tests."""


def keyword_predictor(word, hit, miss):
    """A factory whose predictor answers ``hit`` for prompts holding the word, else ``miss``."""

    def factory():
        return lambda prompts: [hit if word in prompt else miss for prompt in prompts]

    return factory
