"""Text generation back ends. Their libraries are imported on first use, in the process that generates.

Objects are small until called, so they travel to executors; the model is loaded once for each Python worker. With GPUs
give tasks a resource (spark.task.resource.gpu.amount) and turn speculation off for generating stages.
"""

from __future__ import annotations

import asyncio
import os
import random

from .base import REVISION_PROMPT


def device() -> str:
    """The first GPU that Spark gave the task, else cuda where there is one, else cpu."""
    import torch

    from .neural import devices

    return devices(1)[0] or ("cuda" if torch.cuda.is_available() else "cpu")


class _Generator:
    def __init__(self, backend: str, model: str, max_new_tokens: int, temperature: float, n: int = 1, batch_size: int = 8, max_model_len: int = 4096, gpu_memory_utilization: float = 0.9, in_flight: int = 16, attempts: int = 6, pause: float = 1.0) -> None:
        self.backend, self.id, self.max_new_tokens, self.temperature, self.n = backend, model, max_new_tokens, temperature, n
        self.batch_size, self.max_model_len, self.gpu_memory_utilization, self.in_flight = batch_size, max_model_len, gpu_memory_utilization, in_flight
        self.attempts, self.pause = attempts, pause
        self.engine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"engine": None}

    def chat(self, text: str) -> str:
        return text

    def generated(self, texts: list[str]) -> list[list[str]]:
        run = {"hf": self._hf, "vllm": self._vllm, "openai": self._openai}[self.backend]
        return [[x.strip() for x in own] for own in run(texts)]

    def _budget(self, prompt_tokens: int) -> int:
        return self.max_new_tokens

    def _hf(self, texts: list[str]) -> list[list[str]]:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        if self.engine is None:
            tokenizer = AutoTokenizer.from_pretrained(self.id, padding_side="left")
            tokenizer.pad_token = tokenizer.pad_token or tokenizer.eos_token
            self.engine = tokenizer, AutoModelForCausalLM.from_pretrained(self.id, torch_dtype=torch.bfloat16).eval().to(device())
        tokenizer, model = self.engine
        out: list[list[str]] = []
        for i in range(0, len(texts), self.batch_size):
            prompts = [tokenizer.apply_chat_template([{"role": "user", "content": self.chat(t)}], tokenize=False, add_generation_prompt=True) for t in texts[i : i + self.batch_size]]
            batch = tokenizer(prompts, return_tensors="pt", padding=True, truncation=True, max_length=self.max_model_len).to(model.device)
            length = batch["input_ids"].shape[1]
            sampling = {"do_sample": True, "temperature": self.temperature} if self.temperature > 0 else {"do_sample": False}
            with torch.no_grad():
                ids = model.generate(**batch, max_new_tokens=self._budget(length), num_return_sequences=self.n, pad_token_id=tokenizer.pad_token_id, **sampling)
            found = tokenizer.batch_decode(ids[:, length:], skip_special_tokens=True)
            out += [found[j : j + self.n] for j in range(0, len(found), self.n)]
        return out

    def _vllm(self, texts: list[str]) -> list[list[str]]:
        from vllm import LLM, SamplingParams

        if self.engine is None:
            self.engine = LLM(model=self.id, max_model_len=self.max_model_len, gpu_memory_utilization=self.gpu_memory_utilization)
        tokenizer = self.engine.get_tokenizer()
        prompts = [tokenizer.apply_chat_template([{"role": "user", "content": self.chat(t)}], tokenize=False, add_generation_prompt=True) for t in texts]
        sizes = [len(tokenizer.encode(p)) for p in prompts]
        params = [SamplingParams(n=self.n, temperature=self.temperature, max_tokens=max(1, min(self._budget(s), self.max_model_len - s))) for s in sizes]
        return [[o.text for o in one.outputs] for one in self.engine.generate(prompts, params)]

    def _openai(self, texts: list[str]) -> list[list[str]]:
        from openai import AsyncOpenAI

        if not os.environ.get("OPENAI_API_KEY"):
            raise RuntimeError("The 'openai' backend needs OPENAI_API_KEY.")

        async def everything() -> list[list[str]]:
            client, gate = AsyncOpenAI(), asyncio.Semaphore(self.in_flight)

            async def one(text: str) -> list[str]:
                for attempt in range(self.attempts):
                    try:
                        async with gate:
                            return await self.asked(client, text)
                    except Exception as error:
                        if attempt + 1 == self.attempts or getattr(error, "status_code", 500) in (400, 401, 403, 404, 422):
                            raise  # what asking again doesn't mend
                    await asyncio.sleep(self.pause * 2**attempt * (0.5 + random.random()))
                raise AssertionError

            return await asyncio.gather(*map(one, texts))

        return asyncio.run(everything())

    async def asked(self, client, text: str) -> list[str]:
        raise NotImplementedError

    def close(self) -> None:
        """Let go of the model; safe to call again."""
        engine, self.engine = self.engine, None
        if engine is not None and self.backend == "vllm":
            shutdown = getattr(getattr(engine, "llm_engine", None), "shutdown", None)
            if shutdown:
                shutdown()


class Regenerator(_Generator):
    """Prefixes to k continuations each. A chat model's message is the bare prefix, without any preamble."""

    def __init__(self, backend: str, model: str, k: int = 20, max_new_tokens: int = 300, temperature: float = 0.7, **options) -> None:
        super().__init__(backend, model, max_new_tokens, temperature, k, **options)

    def __call__(self, prefixes: list[str]) -> list[list[str]]:
        return self.generated(prefixes)

    async def asked(self, client, text: str) -> list[str]:
        answer = await client.completions.create(model=self.id, prompt=text, n=self.n, max_tokens=self.max_new_tokens, temperature=self.temperature)
        return [c.text for c in answer.choices]


class Reviser(_Generator):
    """Texts to one revision each, greedily."""

    def __init__(self, backend: str, model: str, ceiling: int = 1024, **options) -> None:
        super().__init__(backend, model, ceiling, 0.0, **options)

    def __call__(self, texts: list[str]) -> list[str]:
        return [own[0] if own else "" for own in self.generated(texts)]

    def chat(self, text: str) -> str:
        return REVISION_PROMPT + text

    def _budget(self, prompt_tokens: int) -> int:
        return min(2 * prompt_tokens, self.max_new_tokens)

    async def asked(self, client, text: str) -> list[str]:
        answer = await client.chat.completions.create(model=self.id, temperature=0.0, messages=[{"role": "user", "content": self.chat(text)}])
        return [answer.choices[0].message.content or ""]
